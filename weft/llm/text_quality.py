"""Statistics of texts, and by them the texts that are lists, tables or junk.

The statistics of a document are counts, lengths and shares of its whole text; a batch of texts is one buffer of
bytes, over which all of them are summed at once. A Gaussian mixture with diagonal covariances is fitted to the
standardised statistics of all documents by expectation-maximisation; a pass returns sums per component. How many
components it has is settled by their likelihood (Akaike's criterion) on a bounded sample, where they also start.
Inspected examples say afterwards which components are prose, lists, tables or junk.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.quality_examples import EXAMPLES
from weft.session import cut, spread

KINDS = ["prose", "list", "table", "junk"]
#: Statistics that the mixture sees as logarithms (lengths) and as square roots (ratios and shares).
LENGTHS = ["n_words", "words_per_line", "mean_word_length"]
SHARES = ["symbol_ratio", "digit_ratio", "non_ascii_ratio", "stop_line_share", "common_share", "distinct_word_share", "code_share", "number_share", "inner_symbol_ratio", "nonletter_line_share", "separator_ratio", "short_line_share", "repeated_part_share", "compression"]
STATISTICS = ["n_chars", "n_words", "n_lines", *LENGTHS[1:], *SHARES]
#: Documents (an expected number: those of a share of all hashes) on which the number of components is settled and started;
#: the fit itself sees all.
START_DOCS = 6000
#: Numbers of components that are compared, and starts of each.
COMPONENTS, STARTS = (32, 48, 64, 96), 2
#: Least standard deviation of a component in those of all documents, and documents' worth of it that every component has.
LEAST_SD, PRIOR = 0.15, 0.5
#: The fit ends when a pass raises the mean log-likelihood by less; more passes than these are an error.
GAIN, MOST_PASSES = 1e-3, 300
#: Examples that say what a component is.
NEAREST = 7
#: Bytes of text that are looked at together, and words of a line up to which it is short.
CHUNK, SHORT_LINE = 1 << 20, 6

_SPACE, _BREAK, _LETTER, _DIGIT, _SYMBOL, _TAIL = range(6)


def _byte_classes() -> np.ndarray:
    """The class of each byte of UTF-8; that of a character is the class of its first byte."""
    out = np.full(256, _SYMBOL, np.uint8)
    out[[9, 11, 12, 13, 32]], out[10], out[48:58] = _SPACE, _BREAK, _DIGIT
    out[65:91] = out[97:123] = out[0xC3:0xE2] = out[0xE3:0xEF] = _LETTER
    out[0x80:0xC0] = _TAIL
    return out


def _flags(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in characters]] = True
    return out


_CLASS, _STOP, _END, _SEPARATOR = _byte_classes(), _flags(".!?:;\"')"), _flags(".!?"), _flags(",;|&\t")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE, _MIX, _DOC = np.uint64(1099511628211), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[1], np.full(max(n, 1) - 1, _BASE)]).astype(np.uint64), dtype=np.uint64)


def _run_hashes(low: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes; runs do not overlap and none is empty."""
    if not len(start):
        return np.zeros(0, np.uint64)
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    at = np.arange(int(length.sum())) - np.repeat(first, length)
    values = (low[np.repeat(start, length) + at].astype(np.uint64) + np.uint64(1)) * _powers(int(length.max()))[at]
    return np.add.reduceat(values, first)


def word_hashes(words: list[str]) -> np.ndarray:
    """The sorted hashes of ``words``, by which a batch of texts finds them."""
    coded = [np.frombuffer(w.lower().encode(), np.uint8) for w in words if w.strip()]
    return np.unique(np.array([_run_hashes(b, np.array([0]), np.array([len(b)]))[0] for b in coded], np.uint64))


def _first_of_kind(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of ``key`` and, in it, whether a value comes for the first time."""
    order = np.argsort(key, kind="stable")
    sorted_ = key[order]
    return order, np.concatenate([[True], sorted_[1:] != sorted_[:-1]]) if len(key) else np.zeros(0, bool)


def _spans(mark: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last marked byte of each run from ``start`` to before ``end``; runs without one are left out."""
    at = np.flatnonzero(mark)
    a, b = np.searchsorted(at, start), np.searchsorted(at, end)
    return at[a[b > a]], at[b[b > a] - 1]


def chunk_statistics(texts: list[bytes], common: np.ndarray) -> np.ndarray:
    """One row of ``STATISTICS`` for each of ``texts``, which are UTF-8 with plain line feeds and none blank."""
    n = len(texts)
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    sizes = np.array([len(t) for t in texts])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    cls, low = _CLASS[buf], _LOWER[buf]
    tails = np.flatnonzero(cls == _TAIL)
    is_char = cls != _TAIL
    if len(tails):
        # capital letters of the Latin-1 block, then the class of the first byte for the bytes that follow it
        low[tails[(buf[tails - 1] == 0xC3) & (buf[tails] <= 0x9E) & (buf[tails] != 0x97)]] += 0x20
        for _ in range(3):
            todo = tails[cls[tails] == _TAIL]
            before = cls[todo - 1]
            cls[todo[before != _TAIL]] = before[before != _TAIL]
    per_doc = lambda mask: np.add.reduceat(mask.astype(np.int32), starts).astype(float)
    one = lambda x: np.maximum(x, 1.0)
    shifted = lambda x: np.concatenate([x[:1] * 0, x[:-1]])
    letter, symbol, solid = (cls == _LETTER), (cls == _SYMBOL) & is_char, cls >= _LETTER
    n_chars, n_symbols, n_digits = per_doc(is_char) - 1, per_doc(symbol), per_doc(cls == _DIGIT)
    n_solid = per_doc(solid & is_char)

    in_word = letter | (cls == _DIGIT) | (buf == 95)
    begins = in_word & ~shifted(in_word)
    w_at = np.flatnonzero(begins)
    w_len = np.flatnonzero(in_word & ~np.concatenate([in_word[1:], [False]])) + 1 - w_at
    w_doc = np.searchsorted(starts, w_at, "right") - 1
    words = lambda x: np.bincount(w_doc, weights=x, minlength=n)
    hashes = _run_hashes(low, w_at, w_len)
    found = np.searchsorted(common, hashes)
    is_common = (np.append(common, np.uint64(0))[found] == hashes) & (found < len(common))
    total = lambda mask: np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    letters, digits = total(letter & is_char), total(cls == _DIGIT)
    w_letters, w_digits = letters[w_at + w_len] - letters[w_at], digits[w_at + w_len] - digits[w_at]
    n_words, n_alpha = words(np.ones(len(w_at))), words((w_letters > 0) * 1.0)
    order, new = _first_of_kind(hashes * _MIX + w_doc.astype(np.uint64) * _DOC)
    n_distinct = np.bincount(w_doc[order[new]], minlength=n)
    inner = per_doc((cls == _SYMBOL) & shifted(letter) & np.concatenate([letter[1:], [False]]))

    l_end = np.flatnonzero(cls == _BREAK)
    first, last = _spans(solid, np.concatenate([[0], l_end[:-1] + 1]), l_end)
    l_doc = np.searchsorted(starts, first, "right") - 1
    lines = lambda x: np.bincount(l_doc, weights=x, minlength=n)
    chars, breaks, wordy = total(solid & is_char), _SEPARATOR[buf], total(begins)
    blank = cls == _SPACE
    gap = blank & shifted(blank) & ~shifted(shifted(blank))  # a run of blanks is one separator
    separators = total(breaks | gap)
    l_chars, l_words = (chars[last + 1] - chars[first]).astype(float), wordy[last + 1] - wordy[first]
    l_separators = separators[last + 1] - separators[first]
    n_lines, in_lines = lines(np.ones(len(first))), one(lines(l_chars))
    by_line = {
        "words_per_line": lines(l_words * l_chars) / in_lines, "stop_line_share": lines(_STOP[buf[last]] * 1.0) / one(n_lines), "nonletter_line_share": lines((cls[first] != _LETTER) * l_chars) / in_lines,
        "separator_ratio": lines(np.minimum(l_separators / one(l_words), 1.0) * l_chars) / in_lines, "short_line_share": lines((l_words <= SHORT_LINE) * l_chars) / in_lines,
    }

    # what stands between full stops, question and exclamation marks and line ends
    p_end = np.flatnonzero((cls == _BREAK) | _END[buf])
    first, last = _spans(solid & ~_END[buf], np.concatenate([[0], p_end[:-1] + 1]), p_end)
    p_doc = np.searchsorted(starts, first, "right") - 1
    p_chars = (chars[last + 1] - chars[first]).astype(float)
    order, new = _first_of_kind(_run_hashes(low, first, last + 1 - first) * _MIX + p_doc.astype(np.uint64) * _DOC)
    repeated = np.bincount(p_doc[order[~new]], weights=p_chars[order[~new]], minlength=n)
    packed = np.array([len(zlib.compress(t, 1)) for t in texts], float)

    out = by_line | {
        "n_chars": n_chars, "n_words": n_words, "n_lines": n_lines, "mean_word_length": words((w_letters + w_digits) * 1.0) / one(n_words),
        "symbol_ratio": n_symbols / one(n_solid), "digit_ratio": n_digits / one(n_solid), "non_ascii_ratio": per_doc(buf >= 0xC0) / one(n_chars),
        "common_share": words(is_common * 1.0) / one(n_alpha), "distinct_word_share": n_distinct / one(n_words), "code_share": words(((w_letters > 0) & (w_digits > 0)) * 1.0) / one(n_words),
        "number_share": words((w_letters == 0) * 1.0) / one(n_words), "inner_symbol_ratio": inner / one(n_words), "repeated_part_share": repeated / one(n_solid), "compression": packed / one(sizes),
    }
    return np.stack([out[c] for c in STATISTICS], axis=1)


def _statistics(texts: list[str], common: np.ndarray) -> np.ndarray:
    """``chunk_statistics`` of any number of texts, a bounded number of bytes (or one text) at a time."""
    coded = [t.replace("\r\n", "\n").replace("\r", "\n").encode("utf-8", "replace") for t in texts]
    done, i = [np.zeros((0, len(STATISTICS)))], 0
    while i < len(coded):
        j, size = i + 1, len(coded[i])
        while j < len(coded) and size + len(coded[j]) <= CHUNK:
            size, j = size + len(coded[j]), j + 1
        done.append(chunk_statistics(coded[i:j], common))
        i = j
    return np.concatenate(done)


def text_statistics(docs: DataFrame, common: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with text: its id, a hash of its text and its statistics. Null and blank texts and null
    ids have none.

    Rows that repeat both id and text count once; an id with several texts has a row for each. ``common.word`` is a
    fixed list of words, which becomes part of the plan. Shares of lines count their characters, but for
    ``stop_line_share``, which counts lines; ``compression`` is the compressed size as a part of the whole.
    """
    listed = word_hashes([r["word"] for r in common.where("word is not null").select("word").distinct().collect()])
    clean = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text).alias("t")).where(F.col("t").rlike(r"\S"))
    clean = spread(clean.select("doc_id", "t", F.xxhash64("t").alias("h")))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = _statistics(b.column("t").to_pylist(), listed)
            columns = [pa.array(found[:, i].astype(np.int64) if c.startswith("n_") else found[:, i]) for i, c in enumerate(STATISTICS)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), *columns], names=["doc_id", "h", *STATISTICS])

    fields = ", ".join(f"{c} {'bigint' if c.startswith('n_') else 'double'}" for c in STATISTICS)
    return clean.mapInArrow(describe, f"doc_id {dict(clean.dtypes)['doc_id']}, h bigint, {fields}").dropDuplicates(["doc_id", "h"])


def _vectors(stats: np.ndarray) -> np.ndarray:
    """What the mixture sees of rows of ``STATISTICS``, not yet standardised."""
    at = {c: stats[:, i] for i, c in enumerate(STATISTICS)}
    return np.stack([np.log1p(at[c]) for c in LENGTHS] + [np.sqrt(np.maximum(at[c], 0.0)) for c in SHARES], axis=1)


def _log_joint(x: np.ndarray, means: np.ndarray, sds: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The logarithm of weight and density of every component (columns) at every point (rows)."""
    p = 1 / sds**2
    square = x**2 @ p.T - 2 * x @ (means * p).T + (means**2 * p).sum(1)
    return np.log(weights) - np.log(sds).sum(1) - 0.5 * square - 0.5 * x.shape[1] * np.log(2 * np.pi)


def _responsibilities(x: np.ndarray, means: np.ndarray, sds: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, float]:
    """The share of each component in each point, and the summed log-likelihood."""
    log = _log_joint(x, means, sds, weights)
    top = log.max(1, keepdims=True)
    p = np.exp(log - top)
    total = p.sum(1, keepdims=True)
    return p / total, float((top + np.log(total)).sum())


def _sums(x: np.ndarray, model: tuple) -> tuple[np.ndarray, float]:
    """Per component: weight, sums and sums of squares of the points; and their log-likelihood."""
    r, likelihood = _responsibilities(x, *model)
    return np.hstack([r.sum(0)[:, None], r.T @ x, r.T @ x**2]), likelihood


def _maximised(total: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, standard deviations and weights from the sums; each component has ``PRIOR`` documents of variance 1/4."""
    n = total[:, :1] + 1e-9
    means = total[:, 1 : d + 1] / n
    variance = (np.maximum(total[:, d + 1 :] - n * means**2, 0.0) + PRIOR * 0.25) / (n + PRIOR)
    return means, np.sqrt(np.maximum(variance, LEAST_SD**2)), (n[:, 0] + 1e-6) / (n + 1e-6).sum()


def _started(x: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A mixture of ``k`` components at points far from one another, drawn by their squared distance."""
    rng = np.random.default_rng(seed)
    chosen = [x[rng.integers(len(x))]]
    far = ((x - chosen[0]) ** 2).sum(1)
    for _ in range(k - 1):
        chosen.append(x[rng.choice(len(x), p=far / far.sum())] if far.sum() > 0 else chosen[0])
        far = np.minimum(far, ((x - chosen[-1]) ** 2).sum(1))
    return np.array(chosen), np.full((k, x.shape[1]), 0.5), np.full(k, 1 / k)


def start_mixture(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The mixture of a sample with the smallest information criterion of Akaike among ``COMPONENTS`` and ``STARTS``."""
    best, score = None, np.inf
    for k in [c for c in COMPONENTS if c <= max(len(x) // 2, COMPONENTS[0])]:
        for seed in range(STARTS):
            model, before = _started(x, k, seed), -np.inf
            for _ in range(MOST_PASSES):
                total, likelihood = _sums(x, model)
                model = _maximised(total, x.shape[1])
                if likelihood / len(x) - before < GAIN:
                    break
                before = likelihood / len(x)
            found = 2 * k * (2 * x.shape[1] + 1) - 2 * likelihood
            if found < score:
                best, score = model, found
    return best


def fit_mixture(points: DataFrame, extra: np.ndarray, model: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation over all of ``points.x`` and the rows of ``extra``, from ``model`` until it converges.

    One pass over all points an iteration; only sums per component come back.
    """
    k, d = model[0].shape
    before = -np.inf
    for _ in range(MOST_PASSES):

        def sums(batches: Iterator[pa.RecordBatch], now: tuple = model) -> Iterator[pa.RecordBatch]:
            total, likelihood, n = np.zeros((k, 1 + 2 * d)), 0.0, 0
            for b in batches:
                if b.num_rows:
                    found, more = _sums(_rows(b.column("x"), d), now)
                    total, likelihood, n = total + found, likelihood + more, n + b.num_rows
            values = np.concatenate([[likelihood, n], total.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], names=["i", "v"])

        found = np.zeros(2 + k * (1 + 2 * d))
        for r in points.select("x").mapInArrow(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            found[r["i"]] = r["v"]
        total, own = _sums(extra, model)
        total, own, count = total + found[2:].reshape(k, -1), own + found[0], len(extra) + found[1]
        model = _maximised(total, d)
        if own / count - before < GAIN:
            return model
        before = own / count
    raise RuntimeError(f"the mixture has not converged after {MOST_PASSES} passes")


def _rows(x: pa.Array, d: int) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def component_kinds(examples: np.ndarray, kinds: list[str], model: tuple) -> np.ndarray:
    """Per component the share of ``KINDS`` among the ``NEAREST`` examples by its own measure, the nearer the heavier."""
    means, sds, _ = model
    own = np.array([[float(k == kind) for k in KINDS] for kind in kinds])
    out = []
    for mean, sd in zip(means, sds, strict=True):
        far = (((examples - mean) / sd) ** 2).mean(1)
        near = np.argsort(far, kind="stable")[:NEAREST]
        votes = np.exp(far[near[0]] - far[near]) @ own[near]
        out.append(votes / votes.sum())
    return np.array(out)


def classify(docs: DataFrame, common: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The statistics of each document with text, the probabilities of ``KINDS`` and the likeliest ``kind``.

    The examples count as documents in the fit, so it is defined for an empty table too.
    """
    listed = word_hashes([r["word"] for r in common.where("word is not null").select("word").distinct().collect()])
    stats = cut(text_statistics(docs, common, id_col, text))
    raw = _vectors(_statistics([t for _, t in EXAMPLES], listed))
    d = raw.shape[1]
    vector = F.array(*[F.log1p(F.col(c).cast("double")) for c in LENGTHS], *[F.sqrt(F.greatest(F.col(c), F.lit(0.0))) for c in SHARES])
    points = stats.select("doc_id", "h", vector.alias("x"))
    moments = points.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(f(F.col("x")[i])), F.lit(0.0)) for f in (lambda c: c, lambda c: c * c) for i in range(d)]).first()
    n = moments[0] + len(raw)
    centre = (np.array(moments[1 : d + 1]) + raw.sum(0)) / n
    scale = np.maximum(np.sqrt(np.maximum((np.array(moments[d + 1 :]) + (raw**2).sum(0)) / n - centre**2, 0.0)), 0.05)
    scaled = points.withColumn("x", F.array(*[(F.col("x")[i] - float(centre[i])) / float(scale[i]) for i in range(d)]))
    shown = (raw - centre) / scale
    # a share of all hashes, in their order, so that no task sends more than its share
    part = min(1.0, START_DOCS / max(moments[0], 1))
    drawn = F.pmod(F.xxhash64("h", "doc_id"), F.lit(1 << 40))
    sample = scaled.select("x", drawn.alias("o")).where(F.col("o") < int(part * (1 << 40))).toArrow().combine_chunks().sort_by("o")
    sample = np.vstack([shown, *[_rows(b.column("x"), d) for b in sample.to_batches()]])
    model = fit_mixture(scaled, shown, start_mixture(sample))
    kind_of = component_kinds(shown, [k for k, _ in EXAMPLES], model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = _responsibilities(_rows(b.column("x"), d), *model)[0] @ kind_of if b.num_rows else np.zeros((0, len(KINDS)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), *[pa.array(p[:, i]) for i in range(len(KINDS))], pa.array([KINDS[i] for i in p.argmax(1)], pa.string())], names=["doc_id", "h", *[f"p_{k}" for k in KINDS], "kind"])

    schema = f"doc_id {dict(scaled.dtypes)['doc_id']}, h bigint, {', '.join(f'p_{k} double' for k in KINDS)}, kind string"
    labels = scaled.mapInArrow(label, schema)
    return stats.join(labels, ["doc_id", "h"]).drop("h")


def not_prose(classified: DataFrame) -> DataFrame:
    """``doc_id, kind`` of the documents that the mixture takes for lists, tables or junk."""
    return classified.where(F.col("kind") != "prose").select("doc_id", "kind")
