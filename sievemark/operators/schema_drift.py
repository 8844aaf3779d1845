"""Schemas that drift between files.

Every record is opened once into path/value pairs with the raw type of each value, objects and arrays at
any depth. Pairs are counted by feed, file, path, type and content shape where they are read; shapes are of
a bounded number, so what moves follows files and paths, not rows. Each file is compared with the one before it, which gives added, removed, renamed and
retyped fields; renames, and the content of keys with unknown names, put the fields into one typed table. A
value that does not fit its column is kept as text and named in ``failed_casts``.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievemark.functions.keys import snake_name
from sievemark.session import checkpointed

#: The reference's seven record fields and the types they get in the one table.
REFERENCE_FIELDS = {"ccn": "string", "survey_date": "date", "f_tag": "string", "narrative": "string", "scope_severity": "string", "is_complaint": "boolean", "state": "string"}

TYPES = ("string", "number", "boolean", "object", "array")


VALUE_BUCKETS = 64  #: short values are told apart by a hash into so many

_FORMS = tuple(
    (name, re.compile(pattern))
    for name, pattern in (
        ("yes", r"true|y|yes|t|1"), ("no", r"false|n|no|f|0"), ("day", r"\d{4}-\d{2}-\d{2}.*|\d{1,2}/\d{1,2}/\d{4}"), ("code3", r"[a-z]?\d{3,4}"), ("int", r"-?\d+"), ("decimal", r"-?\d+[.,]\d+"),
        ("mixed", r"(?=.*\d)[a-z0-9]+"), ("letter:", r"[a-l]"), ("initial:", r"[m-z]"), ("pair:", r"[a-z]{2}"), ("blank", r""),
    )
)


@lru_cache(maxsize=200_000)
def _shape(text: str) -> tuple[str, dt.date | None]:
    """A class of content that survives another name or type, one of a bounded number; and the day, if it is one.

    Yes/no words, days, letters and digits by length, numbers, running text; a single letter, a pair of letters
    and other short text also by a bucket of the value.
    """
    t = text.strip().lower()
    name = next((k for k, form in _FORMS if form.fullmatch(t)), None) if len(t) < 40 else None
    if name == "day":
        try:
            return name, dt.date.fromisoformat(t[:10])
        except ValueError:
            return name, None
    if name in ("int", "mixed"):
        return f"{name}{min(12, len(t))}", None
    if name and name[-1] != ":":
        return name, None
    if name is None and len(t) >= 25:
        return "prose", None
    return f"{name or f'word{min(4, len(t.split()))}:'}{zlib.crc32(t.encode()) % VALUE_BUCKETS}", None


class _Number(str):
    """A number as it is written."""


def _pairs(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a key stands twice")
    return out


def _bad(constant: str) -> None:
    raise ValueError(constant)


def read_paths(payload: str | None) -> Iterator[tuple[str, int, str, str | None]]:
    """(path, depth, raw type, text) of everything in a JSON object; elements of an array share the path ``field[]``. Other payloads give nothing.

    Names are trimmed, in lower case, with blanks as underscores. Nested values come after the keys.
    """
    try:
        record = json.loads(payload or "", parse_int=_Number, parse_float=_Number, parse_constant=_bad, object_pairs_hook=_pairs)
    except (ValueError, RecursionError):
        return
    todo = [("", -1, record)] if isinstance(record, dict) else []
    for path, depth, value in todo:  # grows while it is read
        inner = [(f"{path}.{_name(k)}" if depth >= 0 else _name(k), v) for k, v in value.items()] if isinstance(value, dict) else [(f"{path}[]", v) for v in value]
        for name, v in inner:
            if isinstance(v, dict | list):
                todo.append((name, depth + 1, v))
                yield name, depth + 1, "object" if isinstance(v, dict) else "array", None
            elif v is None:
                yield name, depth + 1, "null", None
            else:
                kind = "number" if isinstance(v, _Number) else "string" if isinstance(v, str) else "boolean"
                yield name, depth + 1, kind, v if kind != "boolean" else str(v).lower()


@lru_cache(maxsize=100_000)
def _name(key: str) -> str:
    return re.sub(r"\s", "_", key.strip().lower())


def field_statistics(records: DataFrame, most_held: int = 200_000) -> DataFrame:
    """Counts (n) by feed, file_name, field (a path), depth, raw_type and shape: a bounded number for each path of a file.

    Records are read in Arrow batches and counted where they are read; a task holds at most ``most_held``
    counts and hands them in earlier otherwise. A payload that is null, no JSON or no object counts nothing.
    A day after the release of its file is another shape (day-) than one before it (day+).
    """
    names = ["feed", "file_name", "field", "depth", "raw_type", "shape", "n"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def give() -> pa.RecordBatch:
            columns = list(zip(*((*k, n) for k, n in held.items()))) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

        for b in batches:
            for feed, file_name, released, payload in zip(*(c.to_pylist() for c in b.columns)):
                for path, depth, raw, text in read_paths(payload):
                    if text is None:
                        shape = None if raw == "null" else raw
                    else:
                        shape, day = _shape(text)
                        if shape == "day":
                            shape = "day-" if day and released and day > released else "day+"
                    held[feed, file_name, path, depth, raw, shape] += 1
            if len(held) > most_held:
                yield give()
                held.clear()
        yield give()

    source = records.select("feed", "file_name", F.col("released_at").cast("date").alias("released"), "payload")
    counted = source.mapInArrow(run, "feed string, file_name string, field string, depth int, raw_type string, shape string, n bigint")
    return counted.groupBy(*names[:-1]).agg(F.sum("n").alias("n"))


def path_statistics(records: DataFrame) -> DataFrame:
    """Counts by feed, file, path and raw type, with the paths inside objects and arrays at any depth."""
    return field_statistics(records).groupBy("feed", "file_name", F.col("field").alias("path"), "raw_type").agg(F.sum("n").alias("n"))


def file_sketches(records: DataFrame, min_share: float) -> DataFrame:
    """One row for each file with its place in the feed, the file before it and the fields that at least ``min_share`` of its records carry."""
    cells = F.collect_list(F.struct("raw_type", "shape", "n"))
    fields = field_statistics(records).groupBy("feed", "file_name", "field", "depth").agg(F.sum("n").alias("carry"), cells.alias("cells"))
    order = Window.partitionBy("feed").orderBy(F.col("released_at").asc_nulls_first(), "file_name")
    files = records.groupBy("feed", "file_name").agg(F.count(F.lit(1)).alias("n"), F.min("released_at").alias("released_at"))
    files = files.withColumn("seq", F.row_number().over(order)).withColumn("before", F.lag("file_name").over(order))
    kept = fields.join(files.select("feed", "file_name", "n"), ["feed", "file_name"]).where(F.col("carry") >= min_share * F.col("n"))
    held = kept.groupBy("feed", "file_name").agg(F.collect_list(F.struct("field", "depth", "cells")).alias("fields"))
    return files.select("feed", "file_name", "seq", "before").join(held, ["feed", "file_name"], "left")


def _likeness(a: Counter, b: Counter) -> float:
    """Common share of two fields' shapes. Values of short text count where they repeat in both, else its form alone."""
    by_value = all(_repeats(x) for x in (a, b))
    form = lambda k: k if by_value and k.startswith("word") else k.split(":")[0]
    x, y = Counter(), Counter()
    for c, out in ((a, x), (b, y)):
        for k, n in c.items():
            out[form(k)] += n
    return _overlap(x, y)


def _overlap(x: Counter, y: Counter) -> float:
    nx, ny = sum(x.values()), sum(y.values())
    return sum(min(x[k] / nx, y[k] / ny) for k in x.keys() & y.keys()) if nx and ny else 0.0


def _repeats(c: Counter) -> bool:
    words = {k: n for k, n in c.items() if k.startswith("word")}
    return 3 * len(words) <= sum(words.values())


def _name_likeness(a: str, b: str) -> float:
    grams = lambda s: {s[i : i + 3] for i in range(len(s) - 2)}
    x, y = grams(a), grams(b)
    return len(x & y) / max(1, len(x | y))


def _read(fields: list[dict] | None) -> dict[str, dict]:
    """Depth, type and shapes of each field of a file."""
    out = {}
    for f in fields or []:
        types, shapes = Counter(), Counter()
        for c in f["cells"]:
            if c["raw_type"] != "null":
                types[c["raw_type"]] += c["n"]
                shapes[c["shape"]] += c["n"]
        out[f["field"]] = {"depth": f["depth"], "type": max(TYPES, key=lambda t: (types[t], -TYPES.index(t))) if types else None, "shapes": shapes}
    return out


def _best_pairs(scores: list[tuple[float, str, str]]) -> dict[str, str]:
    """Second name to first name, the best scores first, each name once."""
    out: dict[str, str] = {}
    for _, old, new in sorted((-s, o, n) for s, o, n in scores):
        if old not in out.values() and new not in out:
            out[new] = old
    return out


def _compare(last: dict[str, dict], now: dict[str, dict], min_likeness: float) -> list[tuple]:
    """(field, change, old name, old type, new type, depth) between neighbouring files."""
    parent = lambda k, d: k.rpartition("." if k.rfind(".") > k.rfind("[]") else "[]")[0] if d else ""
    gone, new = sorted(last.keys() - now.keys()), sorted(now.keys() - last.keys())
    scores = []
    for g in gone:
        for n in new:
            if last[g]["depth"] == now[n]["depth"] and parent(g, last[g]["depth"]) == parent(n, now[n]["depth"]):
                like = _likeness(last[g]["shapes"], now[n]["shapes"])
                if like >= min_likeness:
                    scores.append((round(like + _name_likeness(g, n), 6), g, n))
    renamed = _best_pairs(scores)
    out = [(n, "renamed", g, last[g]["type"], now[n]["type"], now[n]["depth"]) for n, g in renamed.items()]
    out += [(n, "added", None, None, now[n]["type"], now[n]["depth"]) for n in new if n not in renamed]
    out += [(g, "removed", None, last[g]["type"], None, last[g]["depth"]) for g in gone if g not in renamed.values()]
    for k, f in now.items():
        old = renamed.get(k, k)
        if old in last and last[old]["type"] and f["type"] and last[old]["type"] != f["type"]:
            out.append((k, "retyped", renamed.get(k), last[old]["type"], f["type"], f["depth"]))
    return out


_EVENT = "feed string, file_name string, seq int, field_name string, change_kind string, old_name string, old_type string, new_type string, depth int, by_content string"


def schema_events(records: DataFrame, min_share: float = 0.1, min_likeness: float = 0.6) -> DataFrame:
    """All changes of every file against the one before, and its keys whose content is that of a missing reference field (change_kind stands_for)."""
    sketches = checkpointed(file_sketches(records, min_share))
    cells = sketches.select(F.explode("fields").alias("f")).where(F.col("f.field").isin(*REFERENCE_FIELDS) & (F.col("f.depth") == 0)).select("f.field", F.explode("f.cells").alias("c"))
    profile: dict[str, Counter] = {k: Counter() for k in REFERENCE_FIELDS}  # shapes of the reference fields where they have their own name
    for r in cells.where("c.shape is not null").groupBy("field", "c.shape").agg(F.sum("c.n").alias("n")).collect():
        profile[r["field"]][r["shape"]] += r["n"]
    before = sketches.select("feed", F.col("file_name").alias("before"), F.col("fields").alias("last"))
    pairs = sketches.join(before, ["feed", "before"], "left").select("feed", "file_name", "seq", F.col("before").isNotNull().alias("follows"), "last", "fields")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                now = _read(r["fields"])
                said = _compare(_read(r["last"]), now, min_likeness) if r["follows"] else []
                out += [(r["feed"], r["file_name"], r["seq"], *x, None) for x in said]
                out += [(r["feed"], r["file_name"], r["seq"], k, "stands_for", None, None, now[k]["type"], 0, ref) for k, ref in _by_content(now, profile).items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 10, [pa.string()] * 2 + [pa.int32()] + [pa.string()] * 5 + [pa.int32(), pa.string()])], names=[x.split()[0] for x in _EVENT.split(", ")])

    events = checkpointed(pairs.mapInArrow(run, _EVENT))
    # a key that stands beside the field in some file is another field
    stands = events.where("change_kind = 'stands_for'").select("field_name", "by_content").distinct()
    names = sketches.select(F.transform(F.filter("fields", lambda f: f["depth"] == 0), lambda f: f["field"]).alias("names"))
    beside = names.select(F.explode("names").alias("field_name"), "names").join(stands, "field_name").where(F.array_contains("names", F.col("by_content"))).select("field_name", "by_content").distinct()
    return events.join(beside, ["field_name", "by_content"], "left_anti")


def schema_changes(records: DataFrame, **options: float) -> DataFrame:
    """feed, file_name, field_name, change_kind (added, removed, renamed, retyped), old_name, old_type, new_type, depth.

    Files follow by released_at, files without it first, ties by name. A field counts when at least
    ``min_share`` of the file's records carry it; it is renamed when the content shapes agree by
    ``min_likeness``. Paths inside objects and arrays (``a.b``, ``a[]``) are compared like keys, at depth 1
    and more, and renamed only inside the same parent. Repeated rows count as delivered. Empty input: no rows.
    Only counts of shapes move, a bounded number for each path of a file; a file is compared in one task
    with the one before it alone, so a feed with many files is no single task.
    """
    return schema_events(records, **options).where("change_kind != 'stands_for'").drop("seq", "by_content")


#: The shapes that values of the reference fields have (any bucket). Where a key is unknown, these tell what it may stand for (the letter f alone looks like a no).
CONTENT = {"ccn": ("int5", "int6", "mixed6"), "survey_date": ("day+",), "f_tag": ("code3",), "narrative": ("prose",), "scope_severity": ("letter", "no"), "is_complaint": ("yes", "no"), "state": ("pair",)}


def _by_content(now: dict[str, dict], profile: dict[str, Counter], min_fit: float = 0.8, min_overlap: float = 0.3) -> dict[str, str]:
    """Keys of a file that stand for a reference field it lacks.

    Most values must have a shape of the field, and where other files carry the field under its own name, the
    key's values must overlap with theirs (``schema_events`` also drops keys that stand beside the field in some file). The better fit wins, then the likelier name.
    """
    scores = []
    for ref in REFERENCE_FIELDS:
        if ref in now:
            continue
        for k, f in now.items():
            total = sum(f["shapes"].values())
            if f["depth"] or k in REFERENCE_FIELDS or not total:
                continue
            fit = sum(n for s, n in f["shapes"].items() if s.split(":")[0] in CONTENT[ref]) / total
            overlap = _overlap(f["shapes"], profile[ref]) if profile[ref] else 1.0
            if ref == "scope_severity" and 2 * sum(n for s, n in f["shapes"].items() if s.startswith("letter")) < total:
                continue
            if fit >= min_fit and overlap >= min_overlap:
                scores.append((round(fit + overlap + _name_likeness(k, ref), 6), ref, k))
    return _best_pairs(scores)


def field_columns(events: DataFrame) -> DataFrame:
    """feed, name, from_seq, to_seq, column_name: the column of every name that a rename or its content gave one, while that holds.

    A renamed field keeps the column of its first name. Only a feed's renames are brought together.
    """

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        column: dict[str, tuple[str, int]] = {}
        out = []
        for seq, part in p.sort_values(["seq", "field_name"]).groupby("seq"):
            new = {r.field_name: column.get(r.old_name, (r.old_name, 0))[0] for r in part.itertuples()}
            for name, target in new.items():
                if name in column:
                    out.append((key[0], name, column[name][1], int(seq) - 1, column[name][0]))
                column[name] = (target, int(seq))
        out += [(key[0], name, since, 2**31 - 1, target) for name, (target, since) in column.items()]
        return pd.DataFrame(out, columns=["feed", "name", "from_seq", "to_seq", "column_name"])

    top = events.where("depth = 0")
    kept = top.where("change_kind = 'renamed'").select("feed", "seq", "field_name", "old_name").groupBy("feed").applyInPandas(run, "feed string, name string, from_seq int, to_seq int, column_name string")
    said = top.where("change_kind = 'stands_for'").select("feed", F.col("field_name").alias("name"), F.col("seq").alias("from_seq"), F.col("seq").alias("to_seq"), F.col("by_content").alias("column_name"))
    return kept.withColumn("rank", F.when(F.col("column_name").isin(*REFERENCE_FIELDS), 0).otherwise(2)).unionByName(said.withColumn("rank", F.lit(1)))


#: What a text field's values look like, blanks around them ignored; others are failed casts. Lost zeros and a lost F are no faults.
FORMS = {"ccn": r"^[0-9A-Za-z]{1,6}$", "f_tag": r"^[FfKk]?\s*\d{1,4}$", "scope_severity": r"^[A-La-l]$", "state": r"^[A-Za-z]{2}$"}


def _text_value(name: str, text: Column, nested: Column) -> Column:
    """The value of a text field, null where it is an object, an array or not of the field's form. A grid cell given as an object becomes its letter."""
    nested = F.coalesce(nested, F.lit(False))
    bare = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    fits = F.when(~nested & bare.rlike(FORMS[name]) if name in FORMS else ~nested, text)
    if name != "scope_severity":
        return fits
    level, scope = (F.get_json_object(text, f"$.{k}") for k in ("severity", "scope"))
    cell = F.when(nested & level.rlike("^[1-4]$") & scope.rlike("^[1-3]$"), F.char(F.lit(61) + 3 * level.cast("int") + scope.cast("int")))
    return F.coalesce(fits, cell)


def _first_value(entries: Column | str, key: Column) -> Column:
    """First non-null value of a key in an array of key/value structs."""
    return _first_entry(entries, key)["value"]


def _first_entry(entries: Column | str, key: Column) -> Column:
    return F.get(F.filter(entries, lambda e: (e["key"] == key) & e["value"].isNotNull()), F.lit(0))


def _once(df: DataFrame) -> DataFrame:
    """The same rows behind a generator of one element, so that later steps do not work its columns out again for each use."""
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("_r")).select("_r.*")


def unified_records(records: DataFrame, broadcast_files: int = 50_000) -> DataFrame:
    """All records as one table.

    Columns: feed, file_name, released_at, position, the seven reference fields with their types,
    ``extra`` (a map from column to text with every other field, strays included) and ``failed_casts``
    (an array of column and value that could not take the column's type; the column is null then). A key
    with a reference field's name is that field; a renamed one keeps the column of its first name; a key
    whose content is that of a reference field the file lacks becomes it, whatever its name. A record whose
    payload does not parse keeps its row, with nulls and the payload under ``failed_casts``. Repeated rows
    stay repeated. The names of up to ``broadcast_files`` files (those with other names) are broadcast, so
    records are not shuffled; beyond, they are joined by shuffle.
    """
    order = Window.partitionBy("feed").orderBy(F.col("released_at").asc_nulls_first(), "file_name")
    files = records.groupBy("feed", "file_name").agg(F.min("released_at").alias("released_at")).select("feed", "file_name", F.row_number().over(order).alias("seq"))
    named = files.join(field_columns(schema_events(records)), "feed").where(F.col("seq").between(F.col("from_seq"), F.col("to_seq")) & ~F.col("name").isin(*REFERENCE_FIELDS))
    one = named.groupBy("feed", "file_name", "name").agg(F.min(F.struct("rank", "column_name"))["column_name"].alias("column_name"))
    by_file = checkpointed(one.groupBy("feed", "file_name").agg(F.map_from_entries(F.collect_list(F.struct("name", "column_name"))).alias("columns")))
    few = by_file.limit(broadcast_files + 1).count() <= broadcast_files
    v = F.try_parse_json("payload")
    # One map for a record: normalised key -> text. Keys that become equal: the first one counts.
    raw = F.expr("from_json(payload, 'map<string,string>')")
    nested = F.expr("transform(map_values(from_json(payload, 'map<string,variant>')), x -> schema_of_variant(x) rlike '^(OBJECT|ARRAY)')")
    base = _once(records.select("feed", "file_name", "released_at", "position", "payload", F.when(F.schema_of_variant(v).startswith("OBJECT"), raw).alias("raw"), nested.alias("nested")))
    joined = base.join(F.broadcast(by_file) if few else by_file, ["feed", "file_name"], "left")
    entries = F.transform(F.map_entries("raw"), lambda e, i: F.struct(F.coalesce(F.element_at("columns", snake_name(e["key"])), snake_name(e["key"])).alias("key"), e["value"].alias("value"), F.get("nested", i).alias("nested")))
    # each field is looked up once, in a projection of its own
    kept = ["feed", "file_name", "released_at", "position", "payload", "raw", "entries"]
    opened = _once(joined.withColumn("entries", entries).select(*kept))
    opened = opened.select(*kept, *[_first_entry("entries", F.lit(k)).alias(f"_{k}") for k in REFERENCE_FIELDS])
    typed, failed = [], []
    for name, kind in REFERENCE_FIELDS.items():
        text = F.col(f"_{name}")["value"]
        t = F.lower(F.trim(text))
        if kind == "boolean":
            value = F.when(t.isin("true", "y", "yes", "t", "1"), True).when(t.isin("false", "n", "no", "f", "0"), False)
        elif kind == "date":
            value = F.coalesce(F.to_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))), F.to_date(F.try_to_timestamp(text, F.lit("M/d/yyyy"))))
        else:
            value = _text_value(name, text, F.col(f"_{name}")["nested"])
        typed.append(value.alias(name))
        failed.append(F.when(text.isNotNull() & (t != "") & value.isNull(), F.struct(F.lit(name).alias("column"), text.alias("value"))))
    failed.append(F.when(F.col("raw").isNull(), F.struct(F.lit("payload").alias("column"), F.col("payload").alias("value"))))
    rest = F.filter("entries", lambda e: ~e["key"].isin(*REFERENCE_FIELDS))
    names = F.array_distinct(F.transform(rest, lambda e: e["key"]))
    extra = F.map_from_arrays(names, F.transform(names, lambda k: _first_value(rest, k)))
    return opened.select("feed", "file_name", "released_at", "position", *typed, extra.alias("extra"), F.filter(F.array(*failed), lambda x: x.isNotNull()).alias("failed_casts"))
