"""Sentences written for the test alone, marked as [kind|text]. None of them comes from the labelled table or its generator."""

SENTENCES = """
At ten past six [person_name|Olumide Farrant] rang the bell and nobody came.
Housekeeping found [person_name|Rosamund Tillery] asleep in the linen room.
We spoke to [person_name|Mr. Hollis Vantongeren] by the elevator.
The shower chair tipped while [person_name|Mrs. Dagny Aurelio] was in it.
His niece [person_name|Perpetua Solheim] brought clean socks.
The charge sheet was initialled by [person_name|T. Quillfeather].
Wound photos of [person_name|Ignatius Brennagh] were missing.
[person_name|Delroy Whitcombe] stated the lift sling was torn.
[person_name|Anneke de Groot] confirmed the fridge log was blank.
The roommate of [person_name|Cosima Bellweather] pressed the button for her.
A grievance by [person_name|Fenella O'Driscoll] was never answered.
Staff called [person_name|Thaddeus] lazy in front of visitors.
Nobody told [person_name|Marguerite Lund-Hansen] about the new pills.
The surgeon, [person_name|Dr. Vikram Sastry], had ordered ice.
[person_name|Beulah Kettering] was found on the bathroom floor at dawn.
Interview notes name [person_name|Casimir Podolski] as the night nurse.
[person_name|ESTELLE FAIRWEATHER] refused the second dose.
The evening pills of [person_name|Leopold Achterberg] stayed in the cup.
Present: [person_name|Ottoline Marsh]
The son, [person_name|Barnaby Cruickshank], waited an hour.
Two aides dragged [person_name|Philippa Norcross] across the carpet.
[person_name|Tobias Engstrom] could not reach his water.
Her sister [person_name|Henrietta] took the photographs.
According to [person_name|Ms. Corazon Dimaculangan], the alarm was off.
Complaint filed by [person_name|Lavinia Stoughton] on Tuesday.
Write to [email|o.farrant@lakemail.com] for the minutes.
The nephew uses [email|dagny_aurelio7@fastpost.net] these days.
Email: [email|cosima@bellweather.org]
Her report was sent to [email|night.desk+falls@carehub.io] twice.
[email|PHILIPPA.N@EXAMPLE.COM] was scribbled on the chart.
The reminder bounced from [email|tobias.e@uni-graz.at] at once.
He spelled it out as [email|barnaby at postbox dot com].
Forward everything to [email|hollis99@mail.kin.us], the note said.
The address [email|ignatius-b@webster.co.uk] was crossed out.
Reply address: [email|beulah.k@homefront.info].
The portal lists ([email|leo.acht@riverpost.de]) as guardian.
She guessed it was [email|casimir @ podolski.pl] and sent it.
Reach the son at [phone|(330) 555-0148] after five.
Phone: [phone|614-555-0173]
The voicemail of [phone|216.555.0119] was full.
Dial [phone|+1 937 555 0164] and ask for the desk.
Her mobile, [phone|9375550182], was switched off.
The cab firm, [phone|1-800-555-0136], never came.
They tried [phone|555-0191] and then gave up.
The hospital rang from [phone|419 555 0127].
An old number, [phone|(740)555-0109], was still on file.
Night line [phone|513-555-0155 ext. 12] rang out.
His cell is [phone|330.555.0188].
[phone|614 555 0142] was written on the wall.
The chart showed SSN [id_number|481-22-7730] in full.
Her social security number [id_number|602 41 9958] was read aloud.
The tray card carried MRN [id_number|4471902].
A slip with medical record no. [id_number|229-41870] lay on the floor.
Medicare number [id_number|3KT8-WN4-PR65] was on the bag.
They photocopied driver's license [id_number|P482-1190-37].
The nurse used license no. [id_number|R5530912].
Medicaid ID: [id_number|OH 44 9021 7]
The screen showed [id_number|733-09-4416] to the whole lobby.
A state ID card [id_number|K204 7713 08] fell behind the bed.
The wristband of the man said MRN [id_number|A8830127].
Someone wrote [id_number|558-71-2093] on the whiteboard.
The taxi took him to [street_address|1420 Maple Ridge Parkway].
Her flat is at [street_address|77 Tannery Row, Apt 4B].
Mail was sent on to [street_address|9 Old Quay Road, Galway].
A deputy found him near [street_address|3308 W. Alder Street].
Discharged to [street_address|512 Copper Beech Lane, Toledo, OH 43604].
The family moved to [street_address|26 Harbor View Drive].
He kept saying he lived at [street_address|1801 North Juniper Avenue].
Bring her back to [street_address|45 Saint Anne Court], the note said.
The parcel went to [street_address|610 S. Delancey Blvd].
Home: [street_address|2217 Peachtree Circle, Macon, GA 31201]
The old farm at [street_address|880 County Line Road] was sold.
Ambulance crews left [street_address|154 E. Third St] at noon.
Questions go to the front office, the poster said.
Fax results to the pharmacy before noon.
Police located the van behind the shed.
Deficiency notices hung in the lobby.
Mercy General Hospital with Alzheimer's disease and Type 2 Diabetes on its list took her back.
Staff B and Resident 12 were in the Willow Wing.
The Hoyer lift, serial 4471-90-2281, was out of order.
Lot 88-113-904 of Heparin was recalled.
Form 22-118-450 was not dated.
Under 42 CFR 483.25(d)(2) the floor must be free of hazards.
Lipitor and Metformin were given at the same hour.
Broken tiles in the Rose Room were taped over.
Room 214 had no soap on 3/14/2024 at 7:45 PM.
Resident #31 weighed 142.6 pounds in March and 131.0 in May.
Blood sugar readings of 201, 188 and 240 were not reported.
Parkinson's Support Group met in Franklin Hall.
Lakeside Manor Nursing Center employs 88 people.
Occupational Therapy ended on the last day of June.
Observation of lunch showed cold soup and no napkins.
Nurse Practitioner visits were not written down.
Order number 118,204 was cancelled by the supplier.
Extension 412 was out of order for a week.
The Director of Nursing said the policy dated 01/05/23 was old.
CNA D turned the alarm off and left.
""".strip().split("\n")


def marked() -> list[tuple[str, list[tuple[str, int, int]]]]:
    out = []
    for line in SENTENCES:
        text, marks = "", []
        rest = line
        while "[" in rest and "|" in rest:
            head, _, tail = rest.partition("[")
            inner, _, rest = tail.partition("]")
            kind, _, value = inner.partition("|")
            text += head
            marks.append((kind, len(text), len(text) + len(value)))
            text += value
        out.append((text + rest, marks))
    return out
