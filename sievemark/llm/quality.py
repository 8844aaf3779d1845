"""Per-document text statistics, and natural prose told from lists, tables and junk.

The statistics of a batch of texts are array operations over all of its characters, words and lines at
once. For each language the mean and covariance of prose are estimated robustly: a start from medians and
interquartile ranges, then concentration steps that keep the documents within a chi-squared quantile of
the current centre, until the centre rests. A statistic measured on few words, letters or lines scatters
more, so a document's own sampling variance is added to the covariance. Every step is one pass over the
statistics; tasks hand in sums, so what reaches the driver is a few numbers for each language.

The squared Mahalanobis distance splits into one contribution for each statistic (they add up to it).
The form of a document is read off these contributions: it is a table or a list where the share of such
lines is by itself an outlier among the prose of its language, and junk where the statistics of its
characters and words are.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.llm.consensus import chi2_quantile
from sievemark.llm.words import hashed, replace, runs, small_batches, text_bytes, valid_text
from sievemark.session import checkpointed

#: The commonest function words of each language. Fixed values.
COMMON_WORDS = {
    "en": "the of and to in a is that it for on with as was be by at or an are from this not have but had his they her she which you one we all were when there can more if no who do so would will been what up out about into than them then only other some could these two may first also after any its over such our their my your he i did does has".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué sólo han yo hay vez puede todos así nos ni parte tiene él uno donde bien e ese otro".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec mais ou son si aux cette on nous sa ses être comme fait été elle tout ont même deux leur lui y ces bien sans où peut après d'un d'une qu'il était avait vous je leurs entre dont aussi encore".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat daß dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wenn kann ich wir sei ihre seine hatte".split(),
}

STATISTICS = ("log_words", "mean_word_length", "symbol_ratio", "digit_ratio", "common_words", "vowel_ratio", "repetition", "list_share", "table_share", "end_punctuation")
LEXICAL = STATISTICS[:7]
RECENT = 50  #: a word that was used among so many words before counts as repeated
_SIZES = ("n_words", "n_chars", "n_letters", "n_tokens", "n_lines", "length_variance")  # what a statistic was measured on

_LETTER, _DIGIT, _BLANK, _VOWEL = 1, 2, 4, 8
_VOWELS = set("aeiouyáéíóúàèìòùâêîôûäëïöüœæ")
_BREAK = "\r\n|[\r\n\x85  ]"
_HIDDEN = "[​‌‍⁠﻿­]+"

_MARKED = r"^\s*(?:[-*+•·–—◦‣▪●○■□☐☑✓✔→➤]|\[[ xX]?\]|\(?\d{1,3}[.):]|\(?[a-zA-Z][.)]|\(?[ivx]{1,4}[.)])\s+\S"
_SHORT, _ENDS_LIKE_A_SENTENCE = r"^\s*[\p{Lu}\p{N}].{1,44}$", r"[.!?:;,…]\s*$"  # a short line that begins like an item and ends like none
_TABLE = (
    r"^\s*(?:\|.*\|\s*|[-+=|: ]*[-+=|][-+=|: ]{2,})\s*$",  # ruled rows
    r"^\s*[^,\s]*(?:,[^,\s]*){2,}\s*$",  # comma cells without blanks
    r"^\s*[^;]*(?: ?; ?[^;]*){2,}\s*$",  # semicolon cells
    r"^\s*[^\t]*(?:\t[^\t]*)+\s*$",  # tab cells
    r"^\s*\S+(?:\s{2,}\S+)+\s*$",  # aligned cells
    r"^\s*[\p{L}_]{1,24}\s?[:=]\s?\S{1,24}\s*$",  # key: value
)
_CELLS = (None, r"[^,\s]{25}", r"[^;]{31}", r"[^\t]{41}", r"\S{25}", None)  # too long for a cell
_INLINE = r"[,;|•]\s| / "
_ENDED = r"[.!?:;…][\"'”’»)\]]*\s*$"


@lru_cache(maxsize=1)
def _alphabet() -> tuple[np.ndarray, np.ndarray]:
    """(kinds, lower case) of the characters of the basic plane; those beyond it are taken as signs."""
    kinds, lower = np.zeros(1 << 16, np.uint8), np.arange(1 << 16, dtype=np.uint32)
    for c in range(1 << 16):
        t = chr(c)
        category = unicodedata.category(t)
        small = t.lower()
        if len(small) == 1:
            lower[c] = ord(small)
        kinds[c] = _LETTER * (category[0] == "L") | _DIGIT * (category == "Nd") | _BLANK * t.isspace() | _VOWEL * (small in _VOWELS)
    return kinds, lower


@lru_cache(maxsize=1)
def _common() -> tuple[np.ndarray, np.ndarray]:
    """Sorted numbers of the common words, and for each the languages it belongs to (a bit each)."""
    bits: dict[int, int] = {}
    for k, words in enumerate(COMMON_WORDS.values()):
        for w in set(words):
            points = np.array([ord(c) for c in w], np.uint32)
            code = int(hashed(points, np.array([0]), np.array([len(points)]))[0])
            bits[code] = bits.get(code, 0) | 1 << k
    codes = np.array(sorted(bits), np.uint64)
    return codes, np.array([bits[int(c)] for c in codes], np.int64)


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values between neighbouring offsets."""
    kind = np.float64 if values.dtype.kind == "f" else np.int32 if len(values) < 1 << 31 else np.int64
    upto = np.cumsum(values, dtype=kind)
    at = np.concatenate([np.zeros(1, kind), upto])[offsets] if len(values) < 1 << 20 else np.where(offsets > 0, upto[np.maximum(offsets, 1) - 1], 0)
    return np.diff(at).astype(np.float64 if kind == np.float64 else np.int64)


def _repeated(codes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Words that also stand among the ``RECENT`` words before them in the same text."""
    out = np.zeros(len(codes), bool)
    order = np.argsort(codes, kind="stable")
    same = (codes[order][1:] == codes[order][:-1]) & (text[order][1:] == text[order][:-1]) & (np.diff(order) <= RECENT)
    out[order[1:][same]] = True
    return out


def _line_shares(texts: pa.Array, n: int) -> dict[str, np.ndarray]:
    split = pc.split_pattern_regex(texts, _BREAK)
    line, owner = pc.list_flatten(split), pc.list_parent_indices(split)
    written = pc.match_substring_regex(line, r"\S")
    line, owner = line.filter(written), owner.filter(written).to_numpy()
    has = lambda pattern, of=line: pc.match_substring_regex(of, pattern).to_numpy(zero_copy_only=False)
    size = pc.utf8_length(line).to_numpy().astype(np.int64)
    marked = has(_MARKED)
    tabled = np.zeros(len(size), bool)
    for pattern, long in zip(_TABLE, _CELLS):
        hit = has(pattern)
        if long is not None and hit.any():
            at = hit.nonzero()[0]
            hit[at[has(long, line.take(pa.array(at)))]] = False
        tabled |= hit
    bare = has(_SHORT) & ~has(_ENDS_LIKE_A_SENTENCE)
    marks = pc.count_substring_regex(line, _INLINE).to_numpy().astype(np.int64)
    inline = marks >= 5
    if inline.any():
        at = inline.nonzero()[0]
        inline[at] = marks[at] * 6 >= pc.count_substring_regex(line.take(pa.array(at)), r"\S+").to_numpy()
    listed = marked | ((bare | inline) & ~tabled)
    add = lambda w: np.bincount(owner, w, minlength=n)
    chars, lines = np.maximum(1, add(size)), add(np.ones(len(size)))
    return {"list_share": add(size * listed) / chars, "table_share": add(size * (tabled & ~marked)) / chars, "end_punctuation": add(has(_ENDED).astype(float)) / np.maximum(1, lines), "n_lines": lines}


def measure(texts: pa.Array, declared: pa.Array) -> dict[str, np.ndarray | list[str]]:
    """The statistics of texts without nulls, and the sizes they were measured on."""
    texts = replace(valid_text(texts), _HIDDEN, "")
    data, offsets = text_bytes(texts)
    kinds, lower = _alphabet()
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]  # offsets in characters
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    low = np.where(points < 1 << 16, points, 0)
    kind = np.where(points < 1 << 16, kinds[low], 0)
    n = len(offsets) - 1
    one = lambda x: np.maximum(1, x)
    chars, blanks = np.diff(at), _sums((kind & _BLANK) > 0, at)
    letters, digits = _sums((kind & _LETTER) > 0, at), _sums((kind & _DIGIT) > 0, at)
    solid = one(chars - blanks)
    begin, _ = runs((kind & _BLANK) == 0, at)
    tokens = one(np.diff(np.searchsorted(begin, at)))
    first, last = runs(((kind & (_LETTER | _DIGIT)) > 0) | (points == 39), at)
    codes = hashed(lower[low], first, last)
    place = np.searchsorted(first, at)
    words = one(np.diff(place))
    size = (last - first).astype(float)
    mean = _sums(size, place) / words
    listed, belongs = _common()
    j = np.minimum(np.searchsorted(listed, codes), len(listed) - 1)
    bits = np.where(listed[j] == codes, belongs[j], 0)
    shares = np.array([_sums((bits >> k) & 1, place) / words for k in range(len(COMMON_WORDS))])
    best, names = shares.max(axis=0), list(COMMON_WORDS)
    said = [x.strip().lower()[:2] if x else "" for x in declared.to_pylist()]
    language = [names[k] if b > 0.05 else s if s in COMMON_WORDS else names[0] for k, b, s in zip(shares.argmax(axis=0), best, said)]
    return {
        "language": language, "log_words": np.log(words + 1.0), "mean_word_length": np.minimum(40.0, solid / tokens),
        "symbol_ratio": np.maximum(0, chars - letters - digits - blanks) / one(chars), "digit_ratio": digits / solid, "common_words": best,
        "vowel_ratio": _sums((kind & _VOWEL) > 0, at) / one(letters), "repetition": _sums(_repeated(codes, np.repeat(np.arange(n), np.diff(place))), place) / words, **_line_shares(texts, n),
        "n_words": words, "n_chars": chars, "n_letters": letters, "n_tokens": tokens, "length_variance": np.maximum(0, _sums(size * size, place) / words - mean * mean),
    }


def text_statistics(documents: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """Statistics of every document that has any non-blank character; null, empty and blank texts give no row.

    Besides the ten statistics of the distance: the sizes they were measured on (n_tokens counts runs of
    other than white space) and language (by common words, else the declared one, else en). Repeated rows
    give repeated rows. Shares are of words, characters or lines; mean_word_length is at most 40;
    repetition is the share of words used already among the ``RECENT`` words before.
    """
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 2 << 20):
            m = measure(pa.concat_arrays([b.column(1)]), b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m["language"], pa.string()), *[pa.array(np.asarray(m[x], float), pa.float64()) for x in (*STATISTICS, *_SIZES)]], names=[key, "language", *STATISTICS, *_SIZES])

    declared = F.col(lang).cast("string") if lang in documents.columns else F.lit(None).cast("string")
    source = documents.select(F.col(key), F.col(text).alias("_text"), declared.alias("_lang")).where(F.regexp_replace("_text", _HIDDEN, "").rlike(r"(?U)\S"))
    return source.mapInArrow(run, f"{key} {kind}, language string, " + ", ".join(f"{x} double" for x in (*STATISTICS, *_SIZES)))


class ProseModel:
    """Centre, covariance and word-length variance of prose for each language, and the distances from it."""

    def __init__(self, centre: np.ndarray, covariance: np.ndarray, word_variance: np.ndarray) -> None:
        self.centre, self.covariance, self.word_variance = centre, covariance, word_variance

    def contributions(self, language: np.ndarray, x: np.ndarray, sizes: np.ndarray, names: tuple[str, ...] = STATISTICS) -> np.ndarray:
        """(n, names) parts of the squared distances."""
        at = [STATISTICS.index(k) for k in names]
        words, chars, letters, tokens, lines = (np.maximum(1.0, sizes[:, i]) for i in range(5))
        c = self.centre[language]
        share = np.clip(c, 0, 1) * (1 - np.clip(c, 0, 1))
        own = np.zeros_like(x)
        for k, base in (("symbol_ratio", chars), ("digit_ratio", chars), ("common_words", words), ("vowel_ratio", letters), ("repetition", words), ("list_share", lines), ("table_share", lines), ("end_punctuation", lines)):
            i = STATISTICS.index(k)
            own[:, i] = share[:, i] / base
        own[:, 1] = self.word_variance[language] / tokens
        cov = self.covariance[language][:, at][:, :, at] + np.eye(len(at))[None] * own[:, at][:, None, :]
        d = (x - c)[:, at]
        return d * np.linalg.solve(cov, d[:, :, None])[:, :, 0]


def _arrays(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language number, statistics, sizes)."""
    names = pa.array(list(COMMON_WORDS))
    column = lambda x: b.column(x).to_numpy(zero_copy_only=False)
    return pc.index_in(b.column("language"), names).to_numpy(zero_copy_only=False).astype(np.int64), np.stack([column(x) for x in STATISTICS], 1), np.stack([column(x) for x in _SIZES], 1)


_GRID = np.stack([np.linspace(0, {"log_words": 30.0, "mean_word_length": 40.0}.get(x, 1.0), 2001) for x in STATISTICS])


def _quartiles(stats: DataFrame) -> np.ndarray:
    """(languages, statistics, 3) quartiles on a grid of 2,000 steps; at most that many counts for each come here. No rows: nan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            language, x, _ = _arrays(b)
            parts = [((language * len(STATISTICS) + i) * _GRID.shape[1] + np.minimum(np.searchsorted(_GRID[i], x[:, i]), _GRID.shape[1] - 1)) for i in range(len(STATISTICS))]
            bins, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bins, pa.int64()), pa.array(n, pa.int64())], names=["bin", "n"])

    found = stats.mapInArrow(run, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(COMMON_WORDS) * len(STATISTICS) * _GRID.shape[1])
    counts[found.column("bin").to_numpy()] = found.column("n").to_numpy()
    counts = counts.reshape(len(COMMON_WORDS), len(STATISTICS), -1)
    out = np.full((*counts.shape[:2], 3), np.nan)
    for k in range(counts.shape[0]):
        for i in range(counts.shape[1]):
            upto = np.cumsum(counts[k, i])
            if upto[-1]:
                out[k, i] = _GRID[i][[np.searchsorted(upto, q * upto[-1]) for q in (0.25, 0.5, 0.75)]]
    return out


def _moments(stats: DataFrame, model: ProseModel, cutoff: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(count, mean, covariance, word variance) of the documents within the cutoff, by language."""
    size = 2 + len(STATISTICS) + len(STATISTICS) ** 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(COMMON_WORDS), size))
        for b in batches:
            language, x, sizes = _arrays(b)
            near = model.contributions(language, x, sizes).sum(1) <= cutoff
            for k in range(len(COMMON_WORDS)):
                m = near & (language == k)
                total[k] += np.concatenate([[m.sum(), sizes[m, 5].sum()], x[m].sum(0), (x[m].T @ x[m]).ravel()])
        for k in range(len(COMMON_WORDS)):
            yield pa.RecordBatch.from_arrays([pa.array([k] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array(total[k])], names=["k", "i", "v"])

    sums = np.zeros((len(COMMON_WORDS), size))
    for r in stats.mapInArrow(run, "k int, i int, v double").groupBy("k", "i").agg(F.sum("v")).collect():
        sums[r[0], r[1]] = r[2]
    n, p = np.maximum(1.0, sums[:, 0]), len(STATISTICS)
    mean = sums[:, 2 : 2 + p] / n[:, None]
    return sums[:, 0], mean, (sums[:, 2 + p :] / n[:, None]).reshape(-1, p, p) - mean[:, :, None] * mean[:, None, :], sums[:, 1] / n


def prose_model(stats: DataFrame, inner: float = 0.975, outer: float = 1 - 1e-6, most_steps: int = 10, least_rows: int = 50) -> ProseModel:
    """The prose of each language.

    Documents within the ``inner`` chi-squared quantile count in a step (and the covariance is scaled up
    for what was cut off); steps end when no centre moves by a hundredth of its deviation. A language's
    deviations are at least those within and between all languages, and those of list and table shares at
    least so wide that a share of one half just reaches the ``outer`` quantile: a text must be for the
    most part such lines. A language with under ``least_rows`` documents takes the centre of all. Without any
    documents there is nothing to measure and the model is empty.
    """
    p = len(STATISTICS)
    cutoff = chi2_quantile(inner, p)
    grow = inner / _chi2_share(cutoff, p + 2)
    half = 0.5 / np.sqrt(chi2_quantile(outer, p))
    layout = [STATISTICS.index(x) for x in ("list_share", "table_share")]
    quart = _quartiles(stats)
    if np.isnan(quart).all():
        return ProseModel(np.zeros((len(COMMON_WORDS), p)), np.stack([np.eye(p)] * len(COMMON_WORDS)), np.zeros(len(COMMON_WORDS)))
    spread = (quart[:, :, 2] - quart[:, :, 0]) / 1.349
    centre = np.where(np.isnan(quart[:, :, 1]), np.nanmean(quart[:, :, 1], axis=0), quart[:, :, 1])
    least = np.maximum(np.nanmax(spread, axis=0), np.ptp(_GRID, axis=1) / 200)
    least[layout] = half
    model = ProseModel(centre, np.stack([np.diag(least**2)] * len(centre)), np.full(len(centre), 4.0))
    for _ in range(most_steps):
        n, mean, cov, words = _moments(stats, model, cutoff)
        enough = n >= least_rows
        pool = n * enough if enough.any() else n
        if not pool.sum():
            break
        weight = pool / pool.sum()
        middle = weight @ mean
        between = np.einsum("k,ki,kj->ij", weight, mean - middle, mean - middle)
        every = (np.einsum("k,kij->ij", weight, cov) + between) * grow
        floor = np.diag(every).copy()
        floor[layout] = np.maximum(floor[layout], half**2)
        floor = np.maximum(floor, (np.ptp(_GRID, axis=1) / 2000) ** 2)
        own = np.where(enough[:, None, None], cov * grow, every)
        own = own + np.stack([np.diag(np.maximum(0, floor - np.diag(c))) for c in own])
        new = ProseModel(np.where(enough[:, None], mean, middle), own, np.where(enough, words, weight @ words))
        moved = np.abs(new.centre - model.centre)[pool > 0] / np.sqrt(floor)
        model = new
        if moved.max() < 0.01:
            break
    return model


def _chi2_share(x: float, k: int) -> float:
    """Share of a chi-squared distribution (k even) below x."""
    term = total = 1.0
    for i in range(1, k // 2):
        term *= x / 2 / i
        total += term
    return 1 - np.exp(-x / 2) * total


def classify_forms(documents: DataFrame, outer: float = 1 - 1e-6, text: str = "text", key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """Statistics, distance, contributions and form (prose, list, table, junk) of every non-blank document.

    ``distance`` is the squared robust Mahalanobis distance from the prose of the document's language,
    ``contributions`` a map whose values add up to it. A table or list is a document whose share of such
    lines contributes more than the ``outer`` chi-squared quantile (the larger contribution counts; equal
    ones: table); junk one whose distance on the statistics of characters and words alone is over that
    quantile. Everything else is prose, also where only its sentence ends or its length are unusual.
    """
    kind = documents.schema[key].dataType.simpleString()
    stats = checkpointed(text_statistics(documents, text, key, lang))  # read once for each step below
    model = prose_model(stats, outer=outer)
    whole, part = chi2_quantile(outer, len(STATISTICS)), chi2_quantile(outer, len(LEXICAL))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            language, x, sizes = _arrays(b)
            c = model.contributions(language, x, sizes)
            lexical = model.contributions(language, x, sizes, LEXICAL).sum(1)
            listed, tabled = (np.where(x[:, i] > model.centre[language, i], c[:, i], 0) for i in (STATISTICS.index("list_share"), STATISTICS.index("table_share")))
            form = np.where(np.maximum(listed, tabled) > whole, np.where(tabled >= listed, "table", "list"), np.where(lexical > part, "junk", "prose"))
            offsets = pa.array(np.arange(len(x) + 1) * len(STATISTICS), pa.int32())
            names = pa.array(list(STATISTICS) * len(x), pa.string())
            more = [pa.MapArray.from_arrays(offsets, names, pa.array(c.ravel())), pa.array(c.sum(1)), pa.array(lexical), pa.array(form.tolist(), pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "contributions", "distance", "lexical_distance", "form"])

    own = ", ".join(f"{x} double" for x in (*STATISTICS, *_SIZES))
    out = stats.mapInArrow(run, f"{key} {kind}, language string, {own}, contributions map<string, double>, distance double, lexical_distance double, form string")
    return out.select(*[F.col(c).cast("bigint").alias(c) if c.startswith("n_") else c for c in out.columns])
