"""A small labelled table of sentences with marked personal information.

Sentences are written with slots; names, numbers, addresses and mail addresses are put together from
short lists of parts by a seeded generator, and some ordinary words are swapped for made-up ones, so a
model has to learn shapes and surroundings, not a list of names. Marks are ``(kind, start, end)`` in
characters. A table of other labelled sentences can be used instead.
"""

from __future__ import annotations

import random
import unicodedata

KINDS = ("email", "phone", "id_number", "street_address", "person_name")

_GIVEN = (
    "Abigail Adele Agnes Alan Alberto Alejandra Amara Andre Anita Anthony Arthur Barbara Beatriz Benjamin Bettina Brenda Brian Bridget Callum Camille Carlos Catherine Cecilia Charles Chiara Clara Clifford Cynthia Daniel Deborah Denise Diego Doris Douglas Edgar Edith Edward Eileen Ellen Emeka Emily Enrique Ernest Esther Eugene Evelyn "
    "Fatima Felix Fernando Frances Gabriel Gerald Gloria Gordon Harold Harriet Hassan Heather Helen Henry Hiroshi Howard Ibrahim Irene Isabel Jacqueline Janet Jerome Joanna Jorge Joyce Juanita Julian Kamala Karen Kenneth Kwame Lakshmi Laura Leonard Lillian Linh Lorraine Lucia Malik Manuel Margaret Marianne Martha Martin Maurice Melvin "
    "Mohammed Monique Morgan Muriel Naomi Natalia Nathan Noor Olga Orlando Pamela Patrick Paula Pedro Philip Phyllis Rachel Rafael Ralph Ramona Raymond Rebecca Richard Roberto Ronald Rosalind Russell Ruth Sadie Samuel Sandra Sharon Sheila Sidney Silvia Simone Stefan Susan Sylvia Teresa Thelma Theodore Vincent Virginia Wendell Winifred Xavier Yolanda Yvonne Zachary Zainab "
    "Joy Faith May Hope Rose Grace Mark Will Dawn June April Frank Bill Grant Pearl Ruby Iris Violet Sandy Chase Drew Penny Ivy Lily Ginger Jack Art Olive Summer Skip Miles Jean-Luc Anne-Marie Mary-Beth Zoë Chloé Jürgen Øystein Łukasz Małgorzata Günther"
).split()
_SURNAME = (
    "Abernathy Acheson Adeyemi Albrecht Alvarez Andersson Appiah Archuleta Baldwin Banerjee Barlow Bautista Beaumont Bergstrom Blackwood Boateng Bowman Bradshaw Brennan Brockman Buchanan Cabrera Callahan Carmichael Castellanos Chakraborty Chaudhry Cisneros Coleman Contreras Crawford Cunningham Czarnecki Dalton Davenport Delgado Dempsey Dominguez Donahue Dubois Eastman Eberhardt Ellison Espinoza "
    "Fairchild Ferguson Figueroa Fitzgerald Fleischer Fontaine Gallagher Gutierrez Haddad Halvorsen Hargrove Hawthorne Henderson Hernandez Hoffmann Holloway Huang Ibarra Iglesias Jankowski Jensen Jimenez Johansson Kamara Kaplan Kavanagh Kawasaki Kowalczyk Krishnan Lafontaine Langford Larsson Lindqvist Lombardi MacGregor Madrigal Mahoney Marchetti Martinez McAllister McNulty Mendoza Mitchell Montgomery Moreau Mukherjee "
    "Nakamura Novak Nwosu Okafor Olivares Ortega Papadakis Patterson Pemberton Petrov Quintero Radcliffe Ramirez Reinhardt Richardson Rosenberg Rutherford Salazar Sandoval Schneider Schwartz Sorensen Stephenson Sullivan Takahashi Thibodeaux Thompson Townsend Valdez Vandermeer Vasquez Villanueva Wainwright Watanabe Weatherby Whitfield Wojcik Yamamoto Zamora Zimmerman"
).split()
_HEAD = "Br Cl D F Gr H L M N P Qu R S Str T V W Y Ch Th K J G Sch Fr Bl Pr Kr Z B".split()
_MIDDLE = "a e i o u ai ou ea ey ar en il or un al".split()
_TAIL = "bert dell ders don gan kett land lick lin man mer nard nock ram rick sen ska son tez thy van well wicz wood zani mond ley ters nik".split()
_STREET = "Maple Ridge,Cedar,Oak Hollow,Washington,Jefferson,Lakeview,Sunnyside,Hillcrest,Walnut,Chestnut Hill,Elmwood,Sycamore,Pine Bluff,Riverside,Meadowbrook,Franklin,Lincoln,Madison,Spring Garden,Orchard,Prospect,Vine,Magnolia,Sunset,Park,Highland,Greenfield,Church,Birchwood,Willow Creek,Dogwood,Forest Glen,Martin Luther King,Queen,College,Mill Pond,Railroad,Airport,State Line,County Farm,Saint Mary,Saint Joseph,Quarry Line,Main,Market,Canal Point,University,Fifth,Eighth,42nd,3rd,Twelfth,St. Charles,San Pedro,La Paz,King George".split(",")
_KIND = "Street St Avenue Ave Road Rd Lane Ln Drive Dr Court Ct Blvd Boulevard Way Place Pl Terrace Ter Parkway Pkwy Row Circle Cir Trail Highway Hwy Crescent Close Square Alley Loop Mews Close Row Gardens".split()
_FOREIGN = "Rue de la Gare,Rue Victor Hugo,Calle del Sol,Avenida Juárez,Avenida de la Paz,Via Garibaldi,Calle Luna,Rue du Moulin,Plaza San Martín,Calle Cinco de Mayo".split(",")
_CITY = "Springfield,Columbus,Dayton,Fort Wayne,Cedar Rapids,Baton Rouge,Tucson,Salem,Albany,Peoria,Little Rock,El Paso,Boise,Fargo,Mobile,Ann Arbor,Santa Fe,Lowell,Erie,St. Paul".split(",")
_STATE = "AL AK AZ AR CA CO CT DE FL GA ID IL IN KS KY LA ME MD MN MO NJ NY OH OR PA RI SC SD TN TX UT VA VT WA WV WY".split()
_HOST = "gmail.com yahoo.com outlook.com hotmail.co.uk aol.com icloud.com comcast.net proton.me cityhospital.org stateagency.gov lakesideclinic.net university.edu smith-family.info valleyhome.us posteo.de orange.fr homecare.biz webmail.ca".split()

_NAMED = (  # {N} a person's name
    "The aide told {N} to wait.|Nobody helped {N} out of the chair.|Medication meant for {N} went to a roommate.|{N} fell twice last month.|{N} denied hearing the alarm.|{N} refused lunch and went back to bed.|{N} has dementia and cannot press the button.|{N} was admitted with a hip fracture."
    "|{N} called the state hotline.|{N} would not sign the form.|{N} reported the missing watch to the desk.|{N} did not receive the ordered wound care.|{N} also complained of pain.|{N} had been left in a wet brief.|{N} and another visitor complained.|{N} wandered out through the kitchen door."
    "|The complaint came from {N}.|Interview with {N} took place in the lobby.|The bruise on {N} was photographed.|Care conference notes list {N} as present.|The guardian, {N}, was never told.|His wife, {N}, brought the bag of clothes.|Her brother {N} visits on Sundays.|The dentist ({N}) did not return the page."
    "|Responsible party: {N}.|Signed: {N}.|Name on the bracelet: {N}.|Attending: {N}.|Witnesses: {N}.|Reported by: {N}|cc: {N}|Next of kin {N} lives nearby.|When the surveyor asked {N}, the answer was no.|A letter addressed to {N} was left on the printer.|\"{N} knows about it,\" the cook said.|\"I told {N} yesterday,\" she said."
    "|The shower was given by {N}.|Dr. on duty that night was {N}.|The bed next to {N} was empty.|Minutes later {N} was found in the hallway.|At breakfast, {N} choked on toast.|During the tour, {N} pointed at the broken lock.|After supper {N} asked for the nurse.|{N}'s chart was empty.|{N}'s daughter took a picture.|The wheelchair of {N} had no brakes."
    "|According to {N}, nobody came.|For {N}, the order was never entered.|Without telling {N}, staff moved the bed.|Staff gave {N} the wrong pill.|Staff moved {N} to another room.|The belt around {N} was too tight.|Two aides lifted {N} without a belt.|{N}, who is blind, missed the cord.|{N}, aged 84, was sitting alone.|{N}: bruise to the arm, no report."
    "|The nurse on the shift was {N}, who left early.|They thanked {N}.|It was {N} who found the open door.|A call from {N} was not returned.|{N} explained that the pager battery was dead.|{N} stated the form was missing.|{N} confirmed the finding.|{N} said, \"It never works.\"|{N} indicated that training was overdue.|{N} acknowledged being late.|{N} verified the temperature log was blank.|{N} was observed without gloves."
    "|{N} scored low on the memory test.|{N} received the dose two hours late.|{N} was seen in the parking lot.|{N} demonstrated the lift.|{N} pulled the cord and waited.|{N} looked pale.|The plan for {N} called for two helpers.|Cold food sat in front of {N}.|A note from {N} asked for help.|The order to turn {N} at night was ignored.|The alarm beeped while {N} slept.|No rounds were made, and {N} lay on the floor.|Water was too hot, and {N} was burned."
)
_MAILED = (
    "Questions go to {E}.|The cousin uses {E} now.|Letters for {E} piled up.|Write to {E} about it.|You can reach the ombudsman at {E}.|Her address is {E}.|E-mail: {E}|Copies went to {E} on Monday.|The son gave {E} as his contact.|Please send the records to {E}.|A sticky note read {E}.|An account under {E} was still open.|{E} was listed twice.|The fax cover sheet named {E}, not the nurse.|The link was mailed to {E} and never opened.|Contact: {E}|He typed {E} into the kiosk.|The sender was {E}.|A reply from {E} was deleted."
)
_PHONED = (
    "Call {P} with questions.|Tel. {P}|Tel: {P} (evenings).|They dialled {P} again and again.|Her phone, {P}, was off.|The number on the card is {P}.|A message was left at {P}.|Home phone {P}, no answer.|Cell: {P}|Fax results to {P}.|Staff called {P} and got a busy tone.|The niece can be reached on {P}.|Telephone {P}|Mobile {P} belongs to the guardian.|The pharmacy line, {P}, was closed.|He wrote {P} on his hand.|Page {P} after hours.|Contact number: {P}.|The family asked staff to ring {P}.|{P} was disconnected.|Dial {P} in an emergency, the sign said."
)
_CARDED = (
    "The screen displayed {I}.|The monitor gave {I} away to the whole room.|Someone had written {I} on a napkin.|A receipt with {I} lay on the counter.|Visitors could read {I} on the whiteboard.|{I} was printed on the envelope.|Her purse held a card: {I}.|The clerk repeated {I} loudly.|Billing used {I} for the wrong person.|A photocopy showed {I}.|Intake sheet: {I}|The form asked for it and showed {I}.|Records under {I} were mixed up.|Under insurance it said {I}.|The badge listed {I}.|The wrist band read {I}.|An unlocked drawer had a list with {I}."
)
_HOMED = (
    "She lives at {A}.|The barn at {A} was empty.|The shop at {A} had closed.|Take her back to {A}, the card said.|The man said he lived at {A}.|Bring him home to {A}.|The crew left {A} at noon.|His old house is at {A}.|Police located her at {A}.|Send the bill to {A}.|Discharge address: {A}|The letter was returned from {A}.|Neighbors saw him outside {A}.|The van left from {A}.|They moved here from {A} last spring.|Her son owns the house at {A}.|Address on file: {A}.|The driver was told {A}.|Mailing address {A}|The daughter, of {A}, complained.|He was picked up near {A} by a deputy.|A package for {A} was opened.|The wallet gave {A} as residence."
)
_DISTRACT = "serial {s}|lot {s}|form {f}|Form {f}|model ZX-{h}-{n}|order number {n},{h}|batch {f}|tag F{h}|room {n}|section {g}|invoice {n}|serial number {s}|lot no. {s}|part {f}|policy {f}|unit {n}|device {s}|the Maple Hollow wing|the Elm Unit|the Rose Lane dining area|purchase order {s}|work order {f}|asset tag {s}|ticket {n}-{h}|extension {n}|bed {n}".split("|")
_HUNG = ["; see {X}.", ", now {X}, per the file.", " - {X}.", " ({X}).", ", {X}.", ": {X}", ", as {X} shows."]  # after a plain sentence

# Sentences put together from parts: subject, verb, preposition, value, ending.
_SUBJECT = "The clerk|A deputy|The new owner|One visitor|His cousin|Nobody|The front desk|An inspector|Some relatives|The driver|Both sisters|A volunteer|The chaplain|Her lawyer|The billing office|A neighbor|The resident|A nurse|The aide|Belongings of one man|The dentist|Two boxes|Mail|The surveyor|Someone|They|She|He|Staff|Papers|The memo|No reply|A copy|The bill".split("|")
_DID = "went|came|walked|wrote|drove|returned|ran|pointed|spoke|was sent|was moved|was taken|was released|was seen|was traced|was delivered|was handed over|were mailed|were carried|arrived|lay waiting|stayed|got lost|was given|was signed|was left|led|had gone|had come|called|moved|was referred|changed".split("|")
_BEFORE = {"{N}": "to with from for by near about behind beside past of against after", "{E}": "to from via at through under by", "{P}": "to from on at via through with by", "{I}": "with under for by showing of as in", "{A}": "to from at near past outside behind toward by around close~to up~from"}
_ENDING = "on Friday|by Monday|by Wednesday|after sunset|that afternoon|twice|in May|last week|unannounced|by taxi|at noon|all night|in error|again|in spring|and left|, which was wrong|, then stopped|, it seems|, she said|, which nobody checked|, though late|, said the note|with no supplies|with tape|on the door|first|||||".split("|")
_ACTED = "told|asked|heard|saw|said|refused|fell|slept|waited|called|left|reported|showed|took|gave|received|needed|wanted|missed|scored|stated|confirmed|was observed|was found|was told|was moved|was seen|had been|has been|did not get|could not reach|looked|lay|stood|complained of|asked for|walked past|spoke about|explained|verified|demonstrated|described|indicated|acknowledged|and a friend heard".split("|")
_OBJECT = "the call bell|a cold tray|the wrong dose|no help|the open door|the wet floor|eleven of fifteen|a torn sheet|pain in the knee|the empty bed|two pills|the old form|nobody nearby|a new plan|the broken lift|her glasses|the night shift|about the rounds|on the floor|in the hall|near the exit|without gloves|to the office|by the window|the list of orders".split("|")
_KIN = "daughter son wife husband brother sister nephew niece cousin guardian roommate visitor volunteer aide nurse cook janitor chaplain dentist doctor patient widow friend neighbor grandson mother father tenant client employee manager supervisor".split()
_NOUN = "photos|charts|requests|statements|visits|weights|lab results|belongings|house|apartment|garage|grave|wound care|bruises|interview|letters|records|claim|room|shoes|glasses|bank card|insurance|discharge|family|store|barn|porch|yard|consent|diet orders|therapy|shower".split("|")
_STATE_OF = "lost|late|empty|blank|old|sold|torn|unlocked|locked|found open|put off|never read|not dated|in the trash|on the list|wet|kept elsewhere|shown to visitors|moved|closed|safe".split("|")
_SAID = "said that|answered that|wrote that|thought|knew that|heard how|asked when|felt that|was told|signed, and|left, but|came because|noted:|wrote: |went where|called while|stayed until|saw how|asked if|read:".split("|")
_OPENING = "Per|And|But|While|According to the log,|During rounds,|On the form,|After lunch,|At the desk,|In the notes,|Before the drill,|That night|Per the report,|Because nobody came,|When asked,|Later|To move|To turn|Failing to help|The order for|The plan of|Beside".split("|")

_OTHERS = (  # organisations, drugs, illnesses, places, days and sentence starts: capitalised, and no one's name
    "Messages left for her were erased.|Complaints left no trace.|Trays left outside grew mold.|Calls made at night were not logged.|Emails piled up.|Voices rose in the hall.|Letters were lost.|By Friday all was clean.|The memo came on Monday.|Reports were due by Tuesday.|It was misspelled.|Nephews, cousins and neighbors came these days.|Bring soup to the table.|Ambulance staff left early.|Parkinson's and Alzheimer's units were closed.|Zoloft and Norvasc were crushed.|Warfarin, Humalog and Plavix were late.|Practitioner notes were lost.|Support Group flyers were old.|Nurse Practitioner orders were not read.|Deficiencies hung on the wall.|Photographs were taken and filed.|The clerk photocopied every page.|He was sent to Mercy General Hospital.|Questions remained about the drill.|Police were called at noon.|Fax machines were out of paper.|Deficiency cited at the last survey.|Transfer to Saint Luke's Medical Center was delayed.|Sunrise Senior Living bought the building.|The Department of Public Health was told.|Tylenol and Ativan were given together.|Lisinopril 10 mg was not held."
    "|Coumadin, Lasix and Seroquel were due at nine.|A diagnosis of Alzheimer's disease was missing.|She has Parkinson's disease and Type 2 Diabetes.|Chronic Obstructive Pulmonary Disease was on the list.|Medicare and Medicaid rules apply.|Blue Cross did not pay.|Physical Therapy and Speech Therapy were stopped.|Hospice Services began in March.|On Monday and Thursday, bingo was cancelled.|Christmas decorations blocked the exit."
    "|The Joint Commission visited.|American Red Cross training had lapsed.|Walgreens delivered the order late.|The Oak Grove Nursing and Rehabilitation Center has ninety beds.|Riverbend Manor changed owners.|Braden Scale and Morse Fall Scale were blank.|Director of Nursing, Administrator and Medical Director signed.|Activities Director position was open.|Licensed Practical Nurse on duty left.|Certified Nurse Aide training was incomplete.|Care Plan Coordinator was absent."
    "|North Hall and West Wing had no heat.|Memory Care was short of staff.|English was not spoken by the aide.|Spanish speaking staff were absent.|Foley catheter bags touched the floor.|Kerlix and Ace wraps were used again.|The Hoyer lift and Sara Stedy were dirty.|Clostridium difficile signs were missing.|Emergency Department notes were lost.|Resident Council met in April.|Lincoln County Health District closed the kitchen.|Ombudsman posters were torn.|Quality Assurance minutes were blank."
    "|Windows in Cedar Court would not close.|Behind Franklin Hall the gate stood open.|Interview and record review were done.|Review of Policy showed no date.|See Exhibit 4.|Notice was given to Social Services.|Staffing was below plan.|Weekend Supervisor did not answer.|Infection Control logs ended in June.|Plan of Correction was late.|Dietary, Laundry and Housekeeping shared one cart.|Insulin was given before Lunch.|Room temperature was low in Building 2.|Minimum Data Set entries were wrong.|Failure to act led to harm.|Observation showed dust.|Narcotic counts were off."
)

_PLAIN = (
    "Based on record review and staff interview, the facility did not document the skin check.|Based on observation, staff failed to count the controlled drugs at shift change.|This REQUIREMENT is not met as evidenced by: staff failed to answer the light promptly.|The findings include:"
    "|Review of the maintenance log found {n} blank entries for {y}.|The policy dated {d} told staff to test the alarm each shift, but training covered only {n} percent of them.|{S} explained nobody had told the team to follow the bowel protocol.|{S} confirmed, \"we do not have time to assist with the noon meal on this hall.\""
    "|{R} was found on the floor of the medication room on {d} with a purple bruise to the right forearm.|{R} received a blood thinner {n} minutes late despite {n} earlier entries.|{R} was restless and asked for help {n} times as the training had lapsed.|{R} scored {n} of 15 on the mental status interview and could not use the wander bracelet."
    "|The care plan listed {n} falls since {d}; none led to a new approach.|Weight fell by {n} kilograms to {n}.{n}, yet the progress notes was not updated.|Blood pressure was {n}/{n} and {R} looked short of breath.|Water in the linen closet measured {n}.{n} degrees, and {R} complained of redness that did not blanch."
    "|The call light in bed {n} by the window had been silenced, and {R} waited {n} minutes.|According to the minimum data set, {S} gave an antipsychotic to the wrong resident at {t}.|When asked, {S} demonstrated the glucose meter download but it was out of reach.|A tray with thickened juice sat untouched beside {R} in the west corridor."
    "|The dietary manager could not find the staffing sheet and said it was kept by a former employee.|The cook verified a turkey sandwich was held at {n}.{n} degrees because the unit was short two aides.|An order to report the bruise to the physician was written on {d} at {t} and never transcribed.|{S} was observed to leave the nurses' station without hand hygiene after the evening shift left."
    "|In an interview over the weekend, the director of nursing acknowledged the facility expected staff to clean the shared lift sling.|The infection preventionist stated the hallway camera displayed an entry that had been copied forward on {d}.|Staff relied on the fall mat sensor alone while the nurse was on break, and rounds were skipped.|{S} pulled the cord in the activity area, and the tele-visit tablet stayed lit without a response."
    "|During the {t} round, {R} was seen in the memory care unit with no staff nearby.|The treatment record for {R} showed an open blister to the both heels first noted the next morning.|No entry in the grievance file explained a hematoma on the forehead.|The surveyor heard the pager sound for {n} minutes in room {n}; {S} walked past twice."
    "|A second resident was seen in the rear exit.|The social services designee indicated the wander bracelet was set to the wrong zone about {n} minutes later.|The assistant director reported the risk score display could not be heard from the desk before breakfast.|The charge nurse did not make sure the door alarm in the dining room worked."
    "|The alarm unit, serial {s}, was replaced after the evening shift left.|The Maple Hollow Care Center logo covered lot {s} on the label.|Form {f} was blank on {d}.|The order number {n},{h} and model ZX-{h}-{n} were both faded.|Staff follow {g} and the Grace period ended in May.|The Rose Lane dining area had {n} empty chairs."
    "|Mark the chart, the sign read, and Will Call stood beside it.|The Foley bag and the Hoyer lift in Room {n} were unlabeled, and the Parkinson's protocol was missing.|Nurse Aide Training Program staff met the Director of Nursing on Elm Unit.|Weights, Emails and Consent forms were kept at the desk."
    "|Blood sugar was checked @ {t} and again @ {t}.|The chapel at Old Mill House was closed, and its street entrance was locked.|The emergency binder named no one; the contact page was blank.|{t} - Review of the care plan found {n} blank entries.|{n}. {S} asked for help.|- {R} was examined and no further harm was found.|The unit manager said hope was low, and the staff may rest."
    "|St. Mark Wing and the Hope Garden were locked at night.|Grace Hall activity calendar listed bingo for {d}.|The May meeting was moved to {d}.|The physician orders for {R} showed swelling to the upper lip.|Over the weekend, the roommate asked about the medication screen.|The facility, tag F{h}, was cited at 483.{n}({l})({n}) on {d}."
    "|The maintenance director confirmed the charting kiosk had a dead battery on {d}.|The administrator indicated the electronic record kept logging staff out.|The regional consultant verified the motion sensor was unplugged.|Invoice {n} and purchase order {s} were on file.|Batch {f} of thickener was recalled.|{R} was tearful, drowsy, calm, sweating, confused, unsteady and upset."
    "|Staff did not offer fluids every two hours, obtain the ordered weight or check placement of the tube.|A nutrition shake, rice and beans, cold eggs, pureed carrots and mechanical soft pork were on the tray.|{R} received eye drops, a diuretic, a thyroid tablet, a pain patch, a sleep aid and an antibiotic late since no one had entered the order even though the family had asked twice."
    "|Weights for the past three weeks read {h}-{h}-{h}, in pounds.|Readings of {h}, {h} and {h} were logged at {t}.|staff failed to transfer {R} with two people.|Based on record review, the facility failed to reposition {R} on schedule for {n} of {n} sampled residents.|An order to transfer {R} with two people was not followed.|One two three, the aide counted, and lifted."
    "|On {d}, {R} was seen in the day room.|On {d} at {t}, {R} was seen in room {n} with no staff nearby.|Since {d}, {R} had asked twice."
    "|Two aides, three nurses and five visitors waited seven minutes.|The shift of nine had four call off, so one was left for six halls.|The policy binder showed a healed scratch, a fracture, a stage two pressure area on the sacral area, lower back and left elbow.|The facility did not make sure the floor mat sensor in room {n} worked, label the opened vials or complete the fall assessment.|The charge nurse, the therapist, the employee, the aides and the nurse were short of staff for {n} of {n} sampled residents."
)


def _surname(r: random.Random) -> str:
    return r.choice(_SURNAME) if r.random() < 0.35 else r.choice(_HEAD) + r.choice(_MIDDLE) + r.choice(_TAIL)


def _name(r: random.Random) -> str:
    given = r.choice(_GIVEN) if r.random() < 0.85 else (r.choice(_HEAD) + r.choice(_MIDDLE) + r.choice(["a", "na", "ko", "el", "is", "ya", "to", "rd", "sha"]))
    last = _surname(r)
    u = r.random()
    if u < 0.10:
        last = "O'" + last
    elif u < 0.18:
        last = r.choice(["de ", "van ", "von ", "della ", "St. "]) + last
    elif u < 0.25:
        last += "-" + _surname(r)
    u = r.random()
    if u < 0.20:
        name = given
    elif u < 0.30:
        name = f"{last}, {given}"
    elif u < 0.36:
        name = f"{r.choice('ABCDEFGHIJKLMNOPRSTVWZ')}. {last}"
    elif u < 0.48:
        name = f"{given} {r.choice('ABCDEFGHIJKLMNOPRSTVWZ')}. {last}"
    elif u < 0.58:
        name = f"{r.choice(['Mr.', 'Mrs.', 'Ms.', 'Dr.', 'Mr', 'Mrs', 'Ms'])} {last}"
    elif u < 0.68:
        name = f"{r.choice(['Mr.', 'Mrs.', 'Ms.', 'Dr.', 'Mr', 'Mrs', 'Ms'])} {given} {last}"
    elif u < 0.78:
        name = f"{given}  {last}{r.choice([' Jr.', ' III', ', RN', ', LPN', ' Sr.'])}"
    else:
        name = f"{given} {last}"
    u = r.random()
    return name.lower() if u < 0.15 else name.upper() if u < 0.26 else name


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _ascii(word: str) -> str:
    return unicodedata.normalize("NFKD", word.lower().replace("ø", "o").replace("ł", "l")).encode("ascii", "ignore").decode()


def _email(r: random.Random) -> str:
    given, last = (_ascii(r.choice(_GIVEN)), _ascii(_surname(r)))
    user = r.choice([f"{given}.{last}", f"{given}_{last}", f"{given[0]}.{last}", f"{given}.{last[0]}", f"{last}.{given}", f"{given}", f"{given}{_digits(r, 4)}", f"{given[0]}{last}", f"{last}{_digits(r, 2)}", f"{last}+home", f"{given}-{r.choice('abcmnostvw')}{_digits(r, 1)}"])
    host = r.choice(_HOST)
    if r.random() < 0.6:
        part = lambda: (r.choice(_HEAD) + r.choice(_MIDDLE) + r.choice(_TAIL)).lower() if r.random() < 0.7 else r.choice("care home mail post office web my the net kin health county".split())
        host = f"{part()}{r.choice(['', '', '-' + part(), '.' + part()])}.{r.choice('com net org info us ca uk de fr io biz gov edu test example invalid local name care'.split())}"
    u = r.random()
    if u < 0.08:
        text = f"{user} at {host.replace('.', ' dot ')}"
    elif u < 0.14:
        text = f"{user}[at]{host.replace('.', '[dot]')}"
    elif u < 0.20:
        text = f"{user} (at) {host}"
    elif u < 0.26:
        text = f"{user} @ {host}"
    else:
        text = f"{user}@{host}"
    return text.upper() if r.random() < 0.15 else text


def _phone(r: random.Random) -> str:
    a, b, c = str(r.randint(201, 989)), r.choice(["555", "555", str(r.randint(200, 999))]), r.choice(["01", _digits(r, 2)]) + _digits(r, 2)
    s = r.choice([f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"{a}{b}{c}", f"+1 {a} {b} {c}", f"+1({a}){b}.{c}", f"1-{a}-{b}-{c}", f"+44 1632 960{_digits(r, 3)}", f"+44 {_digits(r, 2)} {_digits(r, 4)} {_digits(r, 4)}", f"0{_digits(r, 4)} {_digits(r, 6)}", f"0{_digits(r, 4)} {_digits(r, 3)} {_digits(r, 3)}", f"0{_digits(r, 2)} {_digits(r, 4)} {_digits(r, 4)}"])
    if r.random() < 0.12:
        return " ".join("zero one two three four five six seven eight nine".split()[int(x)] for x in a + b + c)
    if r.random() < 0.3:
        s = r.choice([f"{b}-{c}", f"{a}{b}{c}"])
    return s + (r.choice([" x", " ext. "]) + _digits(r, 2) if r.random() < 0.15 else "")


def _id(r: random.Random) -> str:
    head = r.choice(["666", "000", _digits(r, 3), "9" + _digits(r, 2)])
    L = lambda n: "".join(r.choice("ACDEFGHJKLMNPQRTUVWXYZ") for _ in range(n))  # noqa: E731, N806
    d = lambda n: _digits(r, n)
    return r.choice([
        f"SSN {head}-{d(2)}-{d(4)}", f"{head}-{d(2)}-{d(4)}", f"{head}-{d(2)}-{d(4)}", f"{head}-{d(2)}-{d(4)}", f"{head}-{d(2)}-{d(4)}", f"SS# {head}{d(2)}{d(4)}", f"social security number {head} {d(2)} {d(4)}", f"MRN {d(7)}", f"MRN A{d(7)}", f"medical record no. {d(3)}-{d(5)}",
        f"Medicare number {d(1)}{L(2)}{d(1)}-{L(2)}{d(1)}-{L(2)}{d(2)}", f"Medicare number {d(1)}{L(2)}{d(1)}-{L(2)}{d(1)}-{L(2)}{d(2)}", f"Medicaid ID: {L(2)} {d(2)} {d(4)} {d(1)}", f"Medicaid ID: {L(2)} {d(2)} {d(4)} {d(1)}", f"driver's license {L(1)}{d(3)}-{d(4)}-{d(2)}", f"license no. {L(1)}{d(7)}",
        f"state ID card {L(1)}{d(3)} {d(4)} {d(2)}", f"state ID card {L(1)}{d(3)} {d(4)} {d(2)}", f"RN {d(8)}", f"LPN {d(8)}", f"nursing license {d(6)}", f"MBI {d(1)}{L(2)}{d(1)}-{L(2)}{d(1)}-{L(2)}{d(2)}",
    ])


def _address(r: random.Random) -> str:
    street, number = r.choice(_STREET), str(r.randint(1, 9999))
    if r.random() < 0.5:
        made = lambda: r.choice(_HEAD) + r.choice(_MIDDLE) + r.choice(_TAIL)
        street = r.choice([made(), made() + r.choice("field gate marsh moor wick leaf bridge side ton".split()), f"{made()} {r.choice('Hill Bend Gate Hollow Junction Run Point Creek Race Quarry'.split())}", f"St. {made()}'s", f"{r.choice('North South East West Old New Upper'.split())} {made()}"])
    u = r.random()
    if u < 0.14:
        foreign = r.choice(_FOREIGN) if r.random() < 0.5 else f"{r.choice(['Rue', 'Rue de', 'Rue des', 'Calle', 'Avenida', 'Via', 'Plaza', 'Camino'])} {r.choice(_HEAD)}{r.choice(_MIDDLE)}{r.choice(['al', 'ella', 'ova', 'ine', 'es', 'mont', 'ar'])}"
        text = f"{foreign} {r.randint(1, 199)}, {r.choice(_CITY) if r.random() < 0.5 else r.choice(_HEAD) + r.choice(_MIDDLE) + r.choice(_TAIL) + r.choice(['', ' City', ' Falls'])}"
        return text
    if u < 0.26:
        text = f"No. {r.randint(1, 99)} {street} {r.choice(_KIND)}"
    elif u < 0.32:
        text = f"{number}-{r.choice('ABC')} {street} {r.choice(_KIND)}"
    else:
        text = f"{number} {r.choice(['', '', '', 'N. ', 'S. ', 'E. ', 'W. '])}{street} {r.choice(_KIND)}{r.choice(['', '', '', '.'])}"
    text += r.choice(["", "", "", f"\nApt {r.randint(1, 20)}{r.choice('ABC')}", f" Apt {r.randint(1, 20)}{r.choice('ABC')}", f" # {r.randint(1, 60)}", f", Unit {r.randint(1, 60)}"])
    if r.random() < 0.5:
        text += f", {r.choice(_CITY) if r.random() < 0.6 else r.choice(_HEAD) + r.choice(_MIDDLE) + r.choice(_TAIL)}" + (f", {r.choice(_STATE)} {_digits(r, 5)}" if r.random() < 0.75 else "")
    return text.upper() if r.random() < 0.28 else text


def _day(r: random.Random) -> str:
    m, d, y = r.randint(1, 12), r.randint(1, 28), r.randint(2015, 2026)
    month = "January February March April May June July August September October November December".split()[m - 1]
    return r.choice([f"{m}/{d}/{y}", f"{m:02d}/{d:02d}/{y % 100:02d}", f"{month} {d}", f"{m:02d}/{d:02d}/{y}", f"{y}-{m:02d}-{d:02d}"])


def _plain(r: random.Random) -> str:
    text = r.choice((_OTHERS if r.random() < 0.25 else _PLAIN).split("|"))
    if r.random() < 0.04 and text.endswith("."):
        text = text[:-1] + r.choice(_HUNG).replace("{X}", r.choice(_DISTRACT))
    staff = lambda: f"{r.choice(['Staff', 'CNA', 'LPN', 'RN', 'Nurse Aide', 'Med Aide', 'Employee', 'Therapist'])} {r.choice('ABCDEFGHIJKLMNOPQRSTUVW')}"
    someone = lambda: r.choice([f"Resident {r.randint(1, 140)}", f"resident {r.randint(1, 140)}", f"Resident #{r.randint(1, 140)}", f"Resident (R) {r.randint(1, 140)}", f"R{r.randint(1, 140)}", "the resident", "The roommate", "A second resident"])
    fill = {
        "{S}": staff, "{R}": someone, "{d}": lambda: _day(r), "{t}": lambda: r.choice([f"{r.randint(1, 12)}:{r.randint(10, 59)} {r.choice(['AM', 'PM'])}", f"{r.randint(10, 23)}{r.randint(10, 59)} hours", f"{r.randint(10, 23)}{r.randint(10, 59)}"]),
        "{n}": lambda: str(r.randint(1, 199)), "{h}": lambda: str(r.randint(100, 999)), "{y}": lambda: str(r.randint(2015, 2026)), "{s}": lambda: f"{_digits(r, 4)}-{_digits(r, 2)}-{_digits(r, 4)}",
        "{f}": lambda: f"{r.randint(1, 99)}-{r.randint(100, 999)}-{r.randint(100, 999)}", "{g}": lambda: f"48{r.randint(0, 9)}.{r.randint(10, 99)}({r.choice('abcdefg')})({r.randint(1, 9)})", "{l}": lambda: r.choice("abcdefg"),
    }
    for k, f in fill.items():
        while k in text:
            text = text.replace(k, f(), 1)
    return text


def _swap(r: random.Random, text: str, rate: float = 0.08) -> str:
    """Now and then an ordinary word becomes a made-up one, so that unknown words are no sign of anything."""
    words = text.split(" ")
    for i, w in enumerate(words):
        bare = w.strip(".,;:")
        if bare.isalpha() and len(bare) > 3 and r.random() < (rate if bare.islower() else rate / 2 if bare.istitle() else 0):
            new = "".join(r.choice("b c d f g l m n p r s t st tr ch sh pl br th".split()) + r.choice("a e i o u ea ou".split()) for _ in range(r.randint(1, 3))) + r.choice(["", "n", "ed", "s", "ing", "t", "l", "r", "ly", "er"])
            words[i] = w.replace(bare, new.capitalize() if bare.istitle() else new)
    return " ".join(words)


def _built(r: random.Random, slot: str) -> str:
    """A sentence with the slot, put together at random."""
    if slot == "{N}" and r.random() < 0.6:
        opening = f"{r.choice(_OPENING)} " if r.random() < 0.35 else ""
        return f"{opening}{slot} {r.choice(_ACTED)} {r.choice(_OBJECT)}."
    if slot == "{N}" and r.random() < 0.25:
        return f"{r.choice(_NOUN).capitalize()} {r.choice('of by from for with about signed~by filed~by given~to'.split()).replace('~', ' ')} {slot} {r.choice(['was', 'were', 'had been', 'could be', 'is'])} {r.choice(_STATE_OF)}."
    if slot in ("{A}", "{N}") and r.random() < 0.2:
        return f"The {r.choice(_NOUN)} {r.choice('at of near from'.split() if slot == '{A}' else 'of by with for'.split())} {slot} {r.choice(['was', 'is', 'had been'])} {r.choice(_STATE_OF)}."
    if slot == "{N}" and r.random() < 0.4:
        kin = f"{r.choice(['The', 'His', 'Her', 'A', 'One'])} {r.choice(_KIN)}" if r.random() < 0.7 else r.choice(_KIN).capitalize()
        comma = r.choice([", ", " ", " "])
        return f"{kin}{comma}{slot}{',' if comma == ', ' else ''} {r.choice(_ACTED)} {r.choice(_OBJECT)}."
    if slot == "{N}" and r.random() < 0.4:
        return f"{r.choice(_SUBJECT)} {r.choice(_SAID)} {slot} {r.choice(_ACTED)} {r.choice(_OBJECT)}."
    ending = r.choice(_ENDING)
    return f"{r.choice(_SUBJECT)} {r.choice(_DID)} {r.choice(_BEFORE[slot].split()).replace('~', ' ')} {slot}{'' if not ending or ending[0] == ',' else ' '}{ending}."


def _inside(r: random.Random, text: str, slot: str) -> str:
    """An ordinary sentence with the slot somewhere between its words."""
    words = text.split(" ")
    words.insert(r.randrange(1, len(words) + 1), slot)
    return " ".join(words)


def labelled_sentences(n: int = 9000, seed: int = 20240601) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """``n`` texts with their marks, about half of them without any."""
    r = random.Random(seed)
    makers = {"{N}": ("person_name", _name, _NAMED), "{E}": ("email", _email, _MAILED), "{P}": ("phone", _phone, _PHONED), "{I}": ("id_number", _id, _CARDED), "{A}": ("street_address", _address, _HOMED)}
    out = []
    for _ in range(n):
        before, after = _swap(r, _plain(r)), _swap(r, _plain(r))
        u = r.random()
        if u < 0.45:
            text, mark = before + r.choice([" ", " ", "\n"]) + after, []
        else:
            slot = r.choices(list(makers), [6, 2, 3, 5, 5])[0]
            kind, make, carriers = makers[slot]
            value = make(r)
            if r.random() < 0.45:
                carrier, hole = _swap(r, _built(r, slot), 0.2), slot
            elif slot != "{N}" and r.random() < 0.35:
                carrier, hole = _inside(r, _swap(r, _plain(r), 0.15), slot), slot
            elif slot != "{N}" and r.random() < 0.4:
                carrier, hole = before.rstrip(".") + r.choice(_HUNG), "{X}"
                before = _swap(r, _plain(r))
            else:
                carrier, hole = _swap(r, r.choice(carriers.split("|")), 0.15), slot
            lead = before + r.choice([" ", " ", "\n", "\n- ", "\n12. ", "\n0914 - "])
            at = len(lead) + carrier.index(hole)
            text = lead + carrier.replace(hole, value) + r.choice([" ", "\n"]) + after
            mark = [(kind, at, at + len(value))]
        if r.random() < 0.03 and not mark:
            text = text.upper()
        out.append((text, mark))
    return out
