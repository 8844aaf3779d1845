"""Personal information inside free text, found by a linear-chain conditional random field.

A token is described by its word (if the small labelled table has it), its shape and its exact form,
at itself and at up to three places before and after. All of these are properties of the *distinct*
tokens of a batch, so scores are looked up, not computed, for each token of the text. Decoding is exact
Viterbi, but only where a path other than "nothing" can win: an upper bound on what any such stretch
could gain (a running sum that restarts at zero) rules most of the text out beforehand, and the
stretches left are decoded side by side in numpy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.llm.pii_labels import KINDS, labelled_sentences
from sievemark.llm.words import small_batches

LABELS = ("none", *KINDS)
K = len(LABELS)
PLACEHOLDERS = {k: f"[{k.upper()}]" for k in KINDS}
REACH = 3  #: places before and after a token whose properties count
_END = "\n" * REACH

_CLASS = np.zeros(256, np.int8)  # 0 blank, 1 letter, 2 digit, 3 sign, 4 line break
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = 4 if _b in (10, 13) else 0 if _b <= 32 or _b == 127 else 1 if _b >= 128 or _c.isalpha() else 2 if _c.isdigit() else 3


def cut_tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the tokens of UTF-8 bytes: runs of letters, runs of digits, single signs and line breaks."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = _CLASS[data]
    new = np.ones(len(c), bool)
    new[1:] = (c[1:] != c[:-1]) | (c[1:] >= 3)
    start = new.nonzero()[0]
    end = np.append(start[1:], len(c))
    real = c[start] != 0
    return start[real], end[real]


def plain_blanks(data: np.ndarray) -> np.ndarray:
    """The same bytes with unusual blanks (no-break, thin, ideographic and the like) as plain ones, byte for byte."""
    out = data
    for lead, second, third in ((0xC2, (0xA0,), None), (0xE2, (0x80,), (*range(0x80, 0x8B), 0xAF)), (0xE2, (0x81,), (0x9F,)), (0xE3, (0x80,), (0x80,))):
        at = (data[:-2] == lead).nonzero()[0] if len(data) > 2 else np.zeros(0, np.int64)
        at = at[np.isin(data[at + 1], second)]
        if third is not None:
            at = at[np.isin(data[at + 2], third)]
        if len(at):
            out = out.copy() if out is data else out
            for j in range(2 if third is None else 3):
                out[at + j] = 32
    return out


def distinct_tokens(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Number of each token among the distinct ones, and these."""
    if not len(start):
        return np.zeros(0, np.int64), []
    # blanks between tokens become elements of their own and are dropped again
    edges = np.empty(2 * len(start) + 1, np.int64)
    edges[0:-1:2], edges[1::2], edges[-1] = start, end, end[-1]
    spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
    coded = spans.dictionary_encode()
    return coded.indices.to_numpy()[0::2].astype(np.int64), coded.dictionary.to_pylist()


def shape_of(token: str) -> str:
    if token[0].isdigit():
        return f"d{min(len(token), 11)}"
    if not token[0].isalpha():
        return token if token.isascii() else "sign"
    if token.islower():
        return "x" if len(token) == 1 else "xx" if len(token) < 4 else "xxxx"
    if token.isupper():
        return "X" if len(token) == 1 else "XX" if len(token) < 4 else "XXXX"
    return "Xx" if token[1:].islower() else "xX"


@dataclass
class TokenField:
    """Weights: ``words``, ``shapes`` and ``forms`` number the properties; ``weight[p]`` is (2 * REACH + 1, n, K)."""

    words: dict[str, int]
    shapes: dict[str, int]
    forms: dict[str, int]
    weight: list[np.ndarray]
    step: np.ndarray

    def properties(self, tokens: list[bytes]) -> np.ndarray:
        """(n, 3) numbers of word, shape and form; 0 is anything not in the labelled table."""
        out = np.zeros((len(tokens), 3), np.int64)
        for i, b in enumerate(tokens):
            t = b.decode("utf-8", "replace")
            if not t.strip(" ") and t != "\n":
                continue
            word = self.words.get(t.lower(), 0)
            out[i] = word, self.shapes.get(f"{shape_of(t)}{'' if word else '?'}", 0), self.forms.get(t, 0)
        return out

    def tables(self, tokens: list[bytes]) -> np.ndarray:
        """(2 * REACH + 1, n, K) score that a token gives to the label of its neighbour at each distance, against label none."""
        p = self.properties(tokens)
        e = sum(w[:, p[:, i], :] for i, w in enumerate(self.weight))
        return (e - e[:, :, :1]).astype(np.float32)


def _emissions(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Scores of a padded batch (b, t) of token numbers; table's last token is the pad."""
    b, t = ids.shape
    pad = np.full((b, REACH), table.shape[1] - 1)
    wide = np.concatenate([pad, ids, pad], axis=1)
    return sum(table[o][wide[:, REACH - (o - REACH) : REACH - (o - REACH) + t]] for o in range(2 * REACH + 1))


def train_field(examples: list[tuple[str, list[tuple[str, int, int]]]], min_count: int = 3, epochs: int = 12, batch: int = 200, rate: float = 0.08, decay: float = 5e-6, seed: int = 7) -> TokenField:
    """Fit by gradient steps (Adam) on the conditional log-likelihood. Deterministic for a seed."""
    rng = np.random.default_rng(seed)
    rows = []
    for text, marks in examples:
        data = np.frombuffer(text.encode(), np.uint8)
        start, end = cut_tokens(data)
        ids, names = distinct_tokens(data, start, end)
        toks = [names[i] for i in ids]
        y = np.zeros(len(toks), np.int64)
        for kind, a, z in marks:
            a, z = len(text[:a].encode()), len(text[:z].encode())
            y[(start >= a) & (start < z)] = LABELS.index(kind)
        rows.append((toks, y))
    count: dict[str, int] = {}
    ordinary: dict[str, int] = {}
    exact: dict[str, int] = {}
    for toks, y in rows:
        for b, label in zip(toks, y):
            t = b.decode()
            if t[0].isdigit():
                continue
            count[t.lower()] = count.get(t.lower(), 0) + 1
            exact[t] = exact.get(t, 0) + 1
            ordinary[t.lower()] = ordinary.get(t.lower(), 0) + (label == 0)
    words = {w: i + 1 for i, w in enumerate(sorted(w for w, c in count.items() if c >= min_count and (ordinary[w] or len(w) <= 9 or c > 25)))}
    # a word seen only inside marks and seldom says nothing about others like it: it stays unknown
    words = {w: i + 1 for i, w in enumerate(w for w in words if ordinary[w] >= 2 or count[w] > 25)}
    forms = {t: i + 1 for i, t in enumerate(sorted(t for t, c in exact.items() if c >= 4 and t.lower() in words))}
    every = sorted({t for toks, _ in rows for t in toks})
    shapes = {s: i + 1 for i, s in enumerate(sorted({f"{shape_of(t.decode())}{q}" for t in every for q in ("", "?")}))}
    width = 2 * REACH + 1
    field = TokenField(words, shapes, forms, [np.zeros((width, len(v) + 1, K)) for v in (words, shapes, forms)], np.zeros((K, K)))
    props = np.vstack([field.properties(every), np.zeros((1, 3), np.int64)])  # the last one is the pad
    number = {t: i for i, t in enumerate(every)}
    params = [*field.weight, field.step]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    lengths = np.array([len(t) for t, _ in rows])
    order = [i for i in range(len(rows)) if lengths[i]]
    n_step = 0
    for epoch in range(epochs):
        pace = rate * (1 - 0.92 * epoch / epochs)
        rng.shuffle(order)
        groups = [sorted(order[i : i + 4 * batch], key=lambda j: lengths[j]) for i in range(0, len(order), 4 * batch)]
        for chunk in (g[i : i + batch] for g in groups for i in range(0, len(g), batch)):
            t_max = int(lengths[chunk].max())
            ids = np.full((len(chunk), t_max), len(every))
            gold = np.zeros((len(chunk), t_max), np.int64)
            live = np.zeros((len(chunk), t_max), bool)
            for r, j in enumerate(chunk):
                n = lengths[j]
                ids[r, :n] = [number[t] for t in rows[j][0]]
                gold[r, :n], live[r, :n] = rows[j][1], True
            table = sum(w[:, props[:, i], :] for i, w in enumerate(field.weight))
            e = _emissions(table, ids)
            marginal, pairs = _marginals(e, field.step, live)
            delta = -marginal
            np.put_along_axis(delta, gold[..., None], np.take_along_axis(delta, gold[..., None], 2) + 1, 2)
            delta[~live] = 0
            g_table = np.zeros_like(table)
            pad = np.full((len(chunk), REACH), len(every))
            wide = np.concatenate([pad, ids, pad], axis=1)
            for o in range(width):
                at = wide[:, REACH - (o - REACH) : REACH - (o - REACH) + t_max][live]
                for k in range(K):
                    g_table[o, :, k] = np.bincount(at, delta[..., k][live], minlength=len(props))
            grads = []
            for i, w in enumerate(field.weight):
                g = np.zeros_like(w)
                for o in range(width):
                    for k in range(K):
                        g[o, :, k] = np.bincount(props[:, i], g_table[o, :, k], minlength=w.shape[1])
                grads.append(g)
            both = live[:, 1:] & live[:, :-1]
            seen = np.bincount((gold[:, :-1] * K + gold[:, 1:])[both], minlength=K * K).reshape(K, K)
            grads.append(seen - pairs)
            n_step += 1
            for i, (p, g) in enumerate(zip(params, grads)):
                g = g / len(chunk) - decay * p * 50
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                p += pace * (m[i] / (1 - 0.9**n_step)) / (np.sqrt(v[i] / (1 - 0.99**n_step)) + 1e-8)
    return field


def _marginals(e: np.ndarray, step: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label marginals (b, t, K) and expected label pairs (K, K), by scaled forward and backward sums."""
    b, t, _ = e.shape
    x = np.exp(e - e.max(2, keepdims=True))
    w = np.exp(step)
    alpha = np.zeros_like(x)
    alpha[:, 0] = x[:, 0] / x[:, 0].sum(1, keepdims=True)
    scale = np.ones((b, t))
    for i in range(1, t):
        a = (alpha[:, i - 1] @ w) * x[:, i]
        s = a.sum(1)
        alpha[:, i], scale[:, i] = a / s[:, None], s
    beta = np.ones((b, K))
    out = np.zeros_like(x)
    pairs = np.zeros((K, K))
    out[:, t - 1] = alpha[:, t - 1]
    for i in range(t - 2, -1, -1):
        going = live[:, i + 1]
        y = x[:, i + 1] * beta / scale[:, i + 1][:, None]
        joint = (alpha[:, i] * going[:, None]).T @ (y * going[:, None]) * w
        pairs += joint
        beta = np.where(going[:, None], y @ w.T, 1.0)
        out[:, i] = alpha[:, i] * beta
    return out, pairs


def decode(field: TokenField, ids: np.ndarray, names: list[bytes], walls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, labels) of the tokens whose best label is not none. ``walls``: tokens that always are none."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    table = field.tables(names)
    step = (field.step - field.step[0, 0]).astype(np.float32)
    inner = max(0.0, float(step[1:, 1:].max()), float(step[0, 1:].max() + step[1:, 0].max()))
    # first a cheap bound for each token (each neighbour at its best), then the exact scores where it allows
    best = table[:, :, 1:].max(2)
    padded = np.concatenate([np.full(REACH, -1), ids, np.full(REACH, -1)])
    bound = np.zeros(n, np.float32)
    for o in range(2 * REACH + 1):
        at = padded[REACH - (o - REACH) : REACH - (o - REACH) + n]
        bound += np.where(at >= 0, best[o][at], 0)
    bound[walls] = -1e6
    near = _could_win(bound + inner)
    if not near.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = near.nonzero()[0]
    e = np.zeros((len(at), K), np.float32)
    for o in range(2 * REACH + 1):
        t = padded[at + REACH - (o - REACH)]
        e += np.where((t >= 0)[:, None], table[o][t], 0)
    e[np.isin(at, walls), 1:] = -1e6
    tight = np.full(n, -1e6, np.float32)
    tight[at] = e[:, 1:].max(1) + inner
    near = _could_win(tight)
    place = np.full(n, -1)
    place[at] = np.arange(len(at))
    first = (near & ~np.concatenate([[False], near[:-1]])).nonzero()[0]
    last = (near & ~np.concatenate([near[1:], [False]])).nonzero()[0] + 1
    where, what = [], []
    length = last - first
    for low in (1, 3, 5, 9, 17, 33, 65, 129, 257):
        group = ((length >= low) & (length < (low * 2 - 1 if low > 1 else 3))).nonzero()[0] if low < 257 else (length >= 257).nonzero()[0]
        for i in range(0, len(group), 20000 // max(1, low // 8)):
            part = group[i : i + 20000 // max(1, low // 8)]
            t = int(length[part].max())
            grid = first[part][:, None] + np.arange(t)
            live = grid < last[part][:, None]
            scores = np.where(live[..., None], e[place[np.minimum(grid, n - 1)]], 0)
            scores[~live] = [0.0] + [-1e6] * (K - 1)
            y = _viterbi(scores, step)
            hit = (y > 0) & live
            where.append(grid[hit])
            what.append(y[hit])
    if not where:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    w, k = np.concatenate(where), np.concatenate(what)
    order = np.argsort(w)
    return w[order], k[order]


def _could_win(gain: np.ndarray) -> np.ndarray:
    """Tokens inside a stretch whose gains, summed from its start, stay above zero."""
    total = np.cumsum(gain, dtype=np.float64)
    lowest = np.minimum.accumulate(np.concatenate([[0.0], total]))[:-1]
    return total - lowest > 0


def _viterbi(e: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Best labels of a batch (b, t, K) of stretches that begin and end in label none."""
    b, t, _ = e.shape
    score = e[:, 0] + step[0]
    back = np.zeros((b, t, K), np.int8)
    for i in range(1, t):
        s = score[:, :, None] + step
        back[:, i] = s.argmax(1)
        score = s.max(1) + e[:, i]
    y = np.zeros((b, t), np.int64)
    y[:, -1] = (score + step[:, 0]).argmax(1)
    for i in range(t - 1, 0, -1):
        y[:, i - 1] = back[np.arange(b), i, y[:, i]]
    return y


N_EXAMPLES, SEED = 14_000, 20240601
WEIGHTS = Path(__file__).with_name("pii_weights.npz")


def fingerprint(n_examples: int = N_EXAMPLES, seed: int = SEED) -> str:
    """Digest of the labelled table that a field is trained from."""
    return hashlib.sha256(repr(labelled_sentences(n_examples, seed)).encode()).hexdigest()


@lru_cache(maxsize=4)
def default_field(n_examples: int = N_EXAMPLES, seed: int = SEED) -> TokenField:
    """The field of the labelled table that comes with the package.

    The usual one is read from the weights beside this module (``python -m sievemark.llm.pii`` trains and
    writes them; a test holds their fingerprint against the table); any other is trained, half a minute.
    """
    if (n_examples, seed) == (N_EXAMPLES, SEED) and WEIGHTS.exists():
        with np.load(WEIGHTS) as f:
            names = [{w: i + 1 for i, w in enumerate(str(f[k]).split("\t"))} for k in ("words", "shapes", "forms")]
            return TokenField(*names, [f[f"weight{i}"].astype(np.float64) for i in range(3)], f["step"].astype(np.float64))
    return train_field(labelled_sentences(n_examples, seed))


def write_weights(path: Path = WEIGHTS) -> None:
    f = train_field(labelled_sentences(N_EXAMPLES, SEED))
    named = {k: np.array("\t".join(getattr(f, k))) for k in ("words", "shapes", "forms")}
    np.savez_compressed(path, fingerprint=np.array(fingerprint()), step=f.step.astype(np.float32), **named, **{f"weight{i}": w.astype(np.float16) for i, w in enumerate(f.weight)})


def find_spans(field: TokenField, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, kind, first byte, last byte) of every span, bytes counted in the joined text; its bytes and the texts' offsets."""
    texts = pa.concat_arrays([texts.cast(pa.large_string())])
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[: offsets[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    plain = plain_blanks(data)
    start, end = cut_tokens(plain)
    ids, names = distinct_tokens(plain, start, end)
    walls = np.unique(np.searchsorted(start, offsets[1:]) - 1) if len(start) else np.zeros(0, np.int64)
    at, kind = decode(field, ids, names, walls)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none, data, offsets
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (kind[1:] != kind[:-1])
    first = new.nonzero()[0]
    last = np.append(first[1:], len(at)) - 1
    row = np.searchsorted(offsets, start[at[first]], side="right") - 1
    return row, kind[first], start[at[first]], end[at[last]], data, offsets


def _mapped(texts: DataFrame, text: str, key: str, schema: str, make, field: TokenField | None, batch_bytes: int, every: bool) -> DataFrame:  # noqa: ANN001
    """A map over key, text with an end the chain stops at, and whether the text is null; ``every``: also null and empty texts."""
    held = texts.sparkSession.sparkContext.broadcast(field or default_field())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_batches(batches, batch_bytes):
            yield make(part.column(0), part.column(2), *find_spans(held.value, part.column(1)))

    whole = texts.select(F.col(key), F.concat(F.coalesce(F.col(text), F.lit("")), F.lit(_END)).alias("_text"), F.col(text).isNull().alias("_null"))
    return (whole if every else whole.where(F.length("_text") > len(_END))).mapInArrow(run, schema)


def find_personal_information(texts: DataFrame, text: str = "narrative", key: str = "doc_id", field: TokenField | None = None, batch_bytes: int = 8 << 20) -> DataFrame:
    """key, kind and n_spans: how often each kind occurs in a text.

    Null and empty texts give no row. Repeated rows are judged each. Texts are read whole, whatever
    their length; other columns are ignored. A map with no shuffle.
    """

    def make(keys, _null, row, kind, _a, _z, _data, _offsets):  # noqa: ANN001, ANN202
        pair, n = np.unique(row * K + kind, return_counts=True)
        return pa.RecordBatch.from_arrays([keys.take(pa.array(pair // K)), pa.array([LABELS[k] for k in pair % K], pa.string()), pa.array(n, pa.int64())], names=[key, "kind", "n_spans"])

    return _mapped(texts, text, key, f"{key} {texts.schema[key].dataType.simpleString()}, kind string, n_spans bigint", make, field, batch_bytes, False)


def redact(texts: DataFrame, text: str = "narrative", key: str = "doc_id", field: TokenField | None = None, batch_bytes: int = 8 << 20) -> DataFrame:
    """key, the text with every span replaced by the placeholder of its kind, and n_spans.

    Everything outside spans stays as written, byte for byte. Null and empty texts keep their row,
    unchanged, with n_spans 0. One scan, no shuffle.
    """

    def make(keys, null, row, kind, a, z, data, offsets):  # noqa: ANN001, ANN202
        raw = data.tobytes()
        out = [raw[offsets[i] : offsets[i + 1] - len(_END)] for i in range(len(keys))]
        edge = np.searchsorted(row, np.arange(len(keys) + 1))
        for i in np.unique(row):
            parts, at = [], int(offsets[i])
            for j in range(edge[i], edge[i + 1]):
                parts += [raw[at : a[j]], PLACEHOLDERS[LABELS[kind[j]]].encode()]
                at = int(z[j])
            out[i] = b"".join([*parts, raw[at : offsets[i + 1] - len(_END)]])
        texts_out = pa.array([None if no else x.decode("utf-8", "replace") for x, no in zip(out, null.to_pylist())], pa.string())
        return pa.RecordBatch.from_arrays([keys, texts_out, pa.array(np.bincount(row, minlength=len(keys)), pa.int64())], names=[key, text, "n_spans"])

    return _mapped(texts, text, key, f"{key} {texts.schema[key].dataType.simpleString()}, {text} string, n_spans bigint", make, field, batch_bytes, True)


if __name__ == "__main__":
    write_weights()
