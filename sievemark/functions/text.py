"""Column functions on text: boilerplate, tokens, terms, spans, refusals, requirement text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases after which a narrative's own text begins.
BOILERPLATE_MARKERS = ("based on observation", "based on interview", "based on record review", "this requirement is not met as evidenced by")
#: Words that end a requirement's own text.
GUIDANCE_WORDS = ("INTENT", "GUIDANCE", "DEFINITIONS", "PROCEDURES", "KEY ELEMENTS")
#: Fixed value: what a refusal looks like.
REFUSAL = (
    r"(?i)i\s+(?:can(?:no|')t|cannot|won'?t|am\s+unable\s+to)\s+(?:help|assist|analy[sz]e|classify|label|provide|do\s+that)"
    r"|i'?m\s+(?:sorry|not\s+able)|as\s+an\s+ai\b|(?:harmful|inappropriate)\s+content"
)


def count_tokens(c: Column) -> Column:
    """Runs of non-blank characters; 0 for empty text, null for null."""
    return F.regexp_count(c, F.lit(r"(?U)\S+"))


def collapse(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"^ | $", "")


def key_part(c: Column) -> Column:
    """Blanks collapsed, upper case."""
    return F.upper(collapse(c))


def last_place(c: Column, marker: str) -> Column:
    """0-based place of the last occurrence, null when there is none."""
    at = F.locate(marker[::-1], F.reverse(c))
    return F.when(at > 0, F.length(c) - at - len(marker) + 1)


def strip_boilerplate(c: Column, markers: tuple[str, ...] = BOILERPLATE_MARKERS) -> Column:
    """Text after the last marker (the marker that ends furthest), trimmed of ``:,;-`` and blanks; all of it when no marker occurs."""
    low = F.lower(c)
    ends = [last_place(low, m) + len(m) for m in markers]
    cut = F.greatest(*ends) if len(ends) > 1 else ends[0]
    body = F.regexp_replace(F.substring(c, cut + 1, F.length(c)), r"^[ :,;\-\n\t]+|[ :,;\-\n\t]+$", "")
    return F.when(cut.isNotNull(), body).otherwise(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def count_term(text: Column, term: str) -> Column:
    """Whole-word count of a literal term, whatever the case."""
    return F.regexp_count(text, F.lit(r"(?iu)\b\Q" + term.replace(r"\E", r"\E\\E\Q") + r"\E\b"))


def looks_like_refusal(c: Column) -> Column:
    return F.coalesce(c.rlike(REFUSAL), F.lit(False))


def locate_span(text: Column, span: Column) -> tuple[Column, Column]:
    """0-based (start, end) of an exact span; nulls when it is empty or absent."""
    at = F.when(F.length(span) > 0, F.nullif(F.position(span, text), F.lit(0)))
    return (at - 1).cast("bigint"), (at - 1 + F.length(span)).cast("bigint")


REVISION = r"\(Rev\.[^)]*\)"  #: Fixed value: a revision stamp


def requirement_text(block: Column, max_chars: int = 900) -> Column:
    """The requirement itself: revision stamps dropped, cut at the first guidance word, collapsed, at most ``max_chars``."""
    body = F.regexp_replace(block, REVISION, " ")
    at = F.regexp_instr(body, F.lit(r"\b(?:" + "|".join(GUIDANCE_WORDS) + r")\b"))
    part = F.when(at > 0, F.substring(body, F.lit(1), at - 1)).otherwise(F.substring(body, 1, max_chars))
    return F.substring(collapse(part), 1, max_chars)


def build_prompt(template: str, narrative: Column, slot: str = "{{NARRATIVE}}") -> Column:
    """The template with the narrative at every slot; a template without one is refused."""
    if slot not in template:
        raise ValueError(f"the template has no {slot}")
    first, *rest = template.split(slot)
    return F.concat(F.lit(first), *[x for part in rest for x in (narrative, F.lit(part))])


def first_label(c: Column, pairs: tuple[tuple[str, str], ...], default: str) -> Column:
    """Label of the first listed keyword that the text holds."""
    return reduce(lambda acc, kv: acc.when(c.contains(kv[0]), kv[1]), pairs[1:], F.when(c.contains(pairs[0][0]), pairs[0][1])).otherwise(default)
