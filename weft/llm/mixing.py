"""Sources mixed to target shares of all tokens.

Soft memberships: a classifier, trained on a bounded sample of labelled documents, predicts for every document how
likely each source is. What its posteriors are worth is measured on labelled documents held out from the training: the
share of the uncertainty about the source that they take away (``skill``). A labelled document is a member of its own
source, blended with its posterior by that weight; an unlabelled one has its posterior alone.

Projected gradient descent then fits a nonnegative rate per document, so that the expected tokens per source meet their
aims. A step moves the rate of a document along its memberships and projects it between 0 and the cap of its source; a
pass over all documents replays the steps so far, so no rate is stored, and returns sums per source. The tokens of a
labelled document count for its label, so the labels' shares come out and not blended ones. Rates become whole repeats by order sampling, which meets the tokens of each source to a document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.packing import TOKENIZER, count_tokens
from weft.session import cut, spread

#: Labelled documents that the classifier is fitted to and measured on (an expected number: those of a share of all hashes);
#: one in ``HELD_OUT`` measures.
TRAINING_DOCS, HELD_OUT = 10000, 5
#: Hashed features of words, and of lengths besides.
HASHED, SIZES = 4096, 32
#: Passes over the training sample, learning rate, weight decay, and documents of a step of the classifier.
EPOCHS, RATE, DECAY, BATCH = 8, 0.3, 1e-4, 256
#: The fit of rates ends when every source is this close to its aim, as a part of the mix; more steps than these end it too,
#: and the report states what is left.
CLOSE, MOST_STEPS = 1e-6, 200
#: Levels of documents by which part of the tokens that their group gives out they may be: above the first, the second, ...
LEVELS = (20, 1000)
#: Buckets of the order in which repeats are rounded.
BUCKETS = 4096


def _features(text: Column) -> Column:
    """The distinct hashed words of a text and its length (in steps of a quarter power of two) as feature numbers."""
    plain = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(F.lower(plain), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    size = F.least(F.floor(F.log2(F.length(plain) + F.lit(1)) * 2), F.lit(SIZES - 1)).cast("int") + HASHED
    return F.concat(F.array_distinct(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(HASHED)).cast("int"))), F.array(size, F.lit(HASHED + SIZES)))


def _scores(flat: np.ndarray, lengths: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Posteriors (documents by sources) of documents given by their features one after the other; none has no feature.

    A last row of ``weights`` beyond the features is added to every document's scores."""
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    z = np.add.reduceat(weights[flat], first) / np.sqrt(lengths)[:, None]
    if len(weights) > HASHED + SIZES + 1:
        z = z + weights[-1]
    return _softmax(z)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train_classifier(docs: DataFrame, sources: list[str]) -> tuple[np.ndarray, dict]:
    """Weights (features by sources) of a softmax regression of ``source`` on ``text``, and how good it is.

    It is fitted to about ``TRAINING_DOCS`` labelled documents at most, those with the smallest hashes, without every
    fifth of them. On these its scores are tempered: mixed with the logarithms of the sources' shares as far as the log
    loss is least (``temper``, 0 to 1). ``accuracy``, ``largest`` (the share of the largest source) and ``skill`` are measured
    there too; ``skill`` is the part by which the log loss is below that of the shares.
    """
    labelled = docs.where(F.col("source").isin(sources)).withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)))
    part = min(1.0, TRAINING_DOCS / max(labelled.count(), 1))
    sample = labelled.where(F.col("h") < int(part * (1 << 40))).select("h", "source", _features(F.col("text")).alias("f")).toArrow().combine_chunks().sort_by("h")
    w = np.zeros((HASHED + SIZES + 1, len(sources)))
    number = {s: i for i, s in enumerate(sources)}
    y = np.array([number[x] for x in sample.column("source").to_pylist()], int)
    f = sample.column("f").combine_chunks()
    ends = np.concatenate([[0], np.cumsum(f.value_lengths().to_numpy(zero_copy_only=False))]).astype(int)
    flat_all = f.flatten().to_numpy()
    rows = [flat_all[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]
    del sample, f
    fit, held = [i for i in range(len(rows)) if i % HELD_OUT], [i for i in range(len(rows)) if i % HELD_OUT == 0]
    facts = {"accuracy": 0.0, "largest": 0.0, "skill": 0.0, "temper": 0.0}
    if not fit:
        return np.vstack([w, np.zeros((1, len(sources)))]), facts
    prior = (np.bincount(y[fit], minlength=len(sources)) + 0.5) / (len(fit) + 0.5 * len(sources))
    packed = lambda part: (np.concatenate([rows[i] for i in part]), np.array([len(rows[i]) for i in part]))
    for epoch in range(EPOCHS):
        for at in range(0, len(fit), BATCH):
            part = fit[at : at + BATCH]
            flat, lengths = packed(part)
            p = _scores(flat, lengths, w)
            p[np.arange(len(part)), y[part]] -= 1
            spread_ = np.repeat(p / np.sqrt(lengths)[:, None], lengths, axis=0)
            step = np.stack([np.bincount(flat, spread_[:, k], len(w)) for k in range(len(sources))], axis=1)
            w -= RATE / (1 + epoch) * (step / 16 + DECAY * w)
    truth, raw = y[held], np.log(np.maximum(_scores(*packed(held), w), 1e-12))
    loss = lambda z: -np.log(np.maximum(_softmax(z)[np.arange(len(held)), truth], 1e-12)).mean()
    mixed = lambda t: t * raw + (1 - t) * np.log(prior)
    temper = float(min(np.linspace(0, 1, 41), key=lambda t: loss(mixed(t))))
    plain = loss(mixed(0.0))
    # in the weights: all scores by the temper, and the shares on the feature that every document has
    w, bias = w * temper, (1 - temper) * np.log(prior)
    good = {"accuracy": float((mixed(temper).argmax(1) == truth).mean()), "largest": float(prior.max()), "skill": float(max(0.0, 1 - loss(mixed(temper)) / plain)) if plain > 0 else 0.0, "temper": temper}
    return np.vstack([w, bias]), good


def memberships(docs: DataFrame, sources: list[str], weights: np.ndarray, skill: float) -> DataFrame:
    """``doc_id, source, n_tokens, label, m``: the membership of each document in each of ``sources``, summing to 1.

    The classifier sees every document. ``label`` is the number of the source, -1 where it is unknown. A known source
    that is none of ``sources`` is left out.
    """
    index = {s: i for i, s in enumerate(sources)}

    def blend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label = np.array([index.get(x, -1) for x in b.column("source").to_pylist()], np.int32)
            lengths = np.diff(b.column("f").offsets.to_numpy())
            m = _scores(b.column("f").flatten().to_numpy(), lengths, weights) if b.num_rows else np.zeros((0, len(sources)))
            known = np.flatnonzero(label >= 0)
            m[known] *= skill
            m[known, label[known]] += 1 - skill
            own = pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), len(sources)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("n_tokens"), pa.array(label), own], names=["doc_id", "source", "n_tokens", "label", "m"])

    kind = dict(docs.dtypes)["doc_id"]
    wanted = docs.where(F.col("source").isNull() | F.col("source").isin(sources)).where("n_tokens > 0")
    return wanted.select("doc_id", "source", "n_tokens", _features(F.col("text")).alias("f")).mapInArrow(blend, f"doc_id {kind}, source string, n_tokens bigint, label int, m array<double>")


def _arrays(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m = b.column("m").flatten().to_numpy().reshape(b.num_rows, -1)
    return b.column("n_tokens").to_numpy().astype(float), b.column("label").to_numpy(), m


def _replayed(label: np.ndarray, m: np.ndarray, start: np.ndarray, steps: list[np.ndarray], caps: np.ndarray) -> np.ndarray:
    """The rate of each document after ``steps``: each is a move along the memberships, projected to what is allowed."""
    most = np.where(label >= 0, caps[label], m @ caps)
    rate = np.minimum(m @ start, most)
    for step in steps:
        rate = np.clip(rate + m @ step, 0.0, most)
    return rate


def fit_rates(members: DataFrame, targets: np.ndarray, caps: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], dict]:
    """Where the rates start, the steps that they take, and the facts of the fit.

    ``targets`` are shares, ``caps`` the most repeats per source. The expected tokens of a source are those of its labelled
    documents and, of the unlabelled ones, what they are members of it with; their squared distance from the aims is what
    falls. A source without labelled tokens is left out. The size of the mix is the largest that the caps allow to
    labelled documents; should it not be reached, it shrinks. Facts: ``size``, ``caps`` and ``residual``, the largest distance
    of a source from its aim as a part of the mix.
    """
    s = len(targets)

    def totals(start: np.ndarray, steps: list[np.ndarray], caps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each source by labels, and by memberships of the unlabelled."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((2, s))
            for b in batches:
                if b.num_rows:
                    n, label, m = _arrays(b)
                    known, used = label >= 0, n * _replayed(label, m, start, steps, caps)
                    out[0] += np.bincount(label[known], used[known], s)
                    out[1] += used[~known] @ m[~known]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size), pa.int32()), pa.array(out.ravel())], names=["i", "v"])

        out = np.zeros(2 * s)
        for r in members.select("n_tokens", "label", "m").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            out[r["i"]] = r["v"]
        return out[:s], out[s:]

    labelled, soft = totals(np.ones(s), [], np.full(s, 1e9))  # the supply is what there is at a rate of one
    usable = (targets > 0) & (labelled > 0) & (caps > 0)
    if not usable.any():
        return np.zeros(s), [], {"size": 0.0, "residual": 0.0}
    supply, caps = labelled + soft, np.where(usable, caps, 0.0)
    share = np.where(usable, targets, 0.0) / targets[usable].sum()
    size = float(np.min(caps[usable] * labelled[usable] / share[usable]))
    start, steps, before, stuck = np.where(usable, share * size / np.maximum(labelled, 1e-12), 0.0), [], np.inf, 0
    while True:
        known, soft = totals(start, steps, caps)
        left = share * size - known - soft
        residual = float(np.abs(left[usable]).max() / size)
        if residual <= CLOSE or len(steps) == MOST_STEPS:
            return start, steps, {"size": size, "residual": residual, "caps": caps}
        stuck = stuck + 1 if residual > 0.9 * before else 0
        if stuck == 3:  # a source has no more to give
            size, stuck = size * float(np.clip(((known + soft) / np.maximum(share * size, 1e-12))[usable].min(), 0.5, 0.98)), 0
            left = share * size - known - soft
        before = residual
        steps.append(np.where(usable, left / np.maximum(supply, 1e-12), 0.0))


def choose(members: DataFrame, fits: list[tuple[str, np.ndarray, list[np.ndarray], np.ndarray]]) -> DataFrame:
    """``mix_name, doc_id, source, n_tokens, m, repeats`` of the documents that the mixes (name, start, steps, caps) use.

    The whole part of a rate is repeated by every document. Of each group of one source and whole part, documents get one
    more in an order that favours larger fractions (Pareto sampling), until the fractions' tokens are given out. That is
    done level by level, large documents first, and the smaller ones make up for what these are over or under.
    """

    def rates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                _, label, m = _arrays(b)
                for mix, start, steps, caps in fits:
                    rate = np.round(_replayed(label, m, start, steps, caps), 9)
                    some = np.flatnonzero(rate > 0)
                    columns = [c.take(pa.array(some)) for c in b.columns]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(rate[some]), pa.array([mix] * len(some), pa.string())], names=[*b.schema.names, "rate", "mix_name"])

    kind = dict(members.dtypes)["doc_id"]
    rated = members.mapInArrow(rates, f"doc_id {kind}, source string, n_tokens bigint, label int, m array<double>, rate double, mix_name string").drop("label")
    rated = rated.withColumns({"u": (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) + 0.5) / float(1 << 40), "g": F.floor("rate"), "f": F.col("rate") - F.floor("rate")})
    rated = rated.withColumn("k", F.concat_ws("\x01", "mix_name", F.coalesce("source", F.lit("\x02")), F.col("g").cast("string")))
    wanted = F.sum(F.col("f") * F.col("n_tokens"))
    # the driver holds and broadcasts goals only: as many as mixes times sources times whole parts up to the caps (times levels)
    spark, rated = members.sparkSession, cut(rated)
    goal = rated.groupBy("k").agg(wanted.alias("all_wanted"), F.avg("f").alias("mean_f")).collect()
    sized = rated.join(F.broadcast(spark.createDataFrame(goal, "k string, all_wanted double, mean_f double")), "k")
    sized = sized.withColumn("level", sum((F.when(F.col("n_tokens") * part <= F.col("all_wanted"), 1).otherwise(0) for part in LEVELS), F.lit(0)))
    odds = lambda x: (F.lit(1.0) - x) / F.greatest(x, F.lit(1e-12))
    q = F.col("u") / (1 - F.col("u")) * odds(F.col("f")) / F.greatest(odds(F.col("mean_f")), F.lit(1e-12))
    sized = sized.withColumn("t", F.when(F.col("f") > 0, q / (1 + q)).otherwise(1.0)).drop("u", "mean_f", "rate", "all_wanted")
    aims = {(r["k"], r["level"]): r["wanted"] for r in sized.groupBy("k", "level").agg(wanted.alias("wanted")).collect()}
    # what larger documents are over or under; a group without documents of a level passes it on
    done, over = [], {r["k"]: 0.0 for r in goal}
    for level in range(len(LEVELS) + 1):
        here = {k: aims.get((k, level), 0.0) + more for k, more in over.items()}
        if not here:
            break
        one = _first_in_order(sized.where(F.col("level") == level).drop("level").join(F.broadcast(spark.createDataFrame(list(here.items()), "k string, wanted double")), "k"))
        if level < len(LEVELS):
            one = cut(one)
            used = {r["k"]: r["used"] for r in one.groupBy("k").agg(F.sum(F.col("extra") * F.col("n_tokens")).alias("used")).collect()}
            over = {k: v - (used.get(k) or 0) for k, v in here.items()}
        done.append(one)
    if not done:
        return rated.limit(0).select("mix_name", "doc_id", "source", "n_tokens", "m", F.lit(0).alias("repeats"))
    both = reduce(DataFrame.unionByName, done)
    return both.select("mix_name", "doc_id", "source", "n_tokens", "m", (F.col("g") + F.col("extra")).cast("int").alias("repeats")).where("repeats > 0")


def _first_in_order(docs: DataFrame) -> DataFrame:
    """``docs`` with ``extra``: 1 for the first of each group ``k`` in the order of ``t`` that make up ``wanted`` tokens.

    The order is cut into buckets whose sums are added up first, so no window holds more than a bucket.
    """
    docs = docs.withColumn("b", F.least(F.floor(F.col("t") * BUCKETS), F.lit(BUCKETS - 1)))
    per_bucket = docs.groupBy("k", "b").agg(F.sum("n_tokens").alias("in_bucket"))
    offsets = per_bucket.select("k", "b", (F.sum("in_bucket").over(Window.partitionBy("k").orderBy("b")) - F.col("in_bucket")).alias("before"))
    placed = docs.join(offsets, ["k", "b"])
    # a document without a fraction gets none; the one at the boundary is taken if more than half of it is wanted
    asked = (F.col("f") > 0) & (F.col("before") <= F.col("wanted"))
    inside = Window.partitionBy("k", "b").orderBy("t", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.col("before") + F.sum("n_tokens").over(inside)
    taken = placed.where(asked).withColumn("extra", F.when(upto - F.col("n_tokens") / 2 <= F.col("wanted"), 1).otherwise(0))
    return taken.unionByName(placed.where(~asked).withColumn("extra", F.lit(0))).drop("before", "b", "t", "wanted", "f")


def _fitted(docs: DataFrame, targets: DataFrame, tokenizer: str) -> tuple[DataFrame, list[tuple]]:
    """The choice of every mix with memberships, and ``mix_name, source, i, residual, skill, accuracy, largest`` of each fit."""
    docs = docs.where("doc_id is not null").select("doc_id", "text", "source")
    wanted = targets.where("mix_name is not null and source is not null").select("mix_name", "source", "target_share", "max_repeats").toPandas()
    sources = sorted(wanted["source"].unique())
    out = docs.sparkSession.createDataFrame([], f"mix_name string, doc_id {dict(docs.dtypes)['doc_id']}, source string, n_tokens bigint, m array<double>, repeats int")
    facts: list[tuple] = []
    fits: list[tuple] = []
    if not sources:
        return out, facts
    sized = count_tokens(spread(docs), "text", "n_tokens", tokenizer)
    weights, good = train_classifier(docs, sources)
    members = cut(memberships(sized, sources, weights, good["skill"]))
    for mix, part in sorted(wanted.groupby("mix_name")):
        by = part.groupby("source").agg({"target_share": "sum", "max_repeats": "max"}).reindex(sources).fillna(0)
        start, steps, fit = fit_rates(members, by["target_share"].to_numpy(float), by["max_repeats"].to_numpy(float))
        if fit["size"]:
            fits.append((mix, start, steps, fit["caps"]))
        facts += [(mix, x, i, fit["residual"], good["skill"], good["accuracy"], good["largest"]) for i, x in enumerate(sources)]
    return (choose(members, fits) if fits else out), facts


def mix_all(docs: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """The choice of every mix of ``targets`` (``mix_name, source, target_share, max_repeats``, a small table).

    ``docs`` has ``doc_id, text, source``. Texts without an id or tokens are never chosen, nor those of a source that is no
    target; repeated rows count each. A source without documents is left out, and the shares of the others keep their
    proportions.
    """
    return _fitted(docs, targets, tokenizer)[0].drop("m")


def mix_report(docs: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``share_report`` with ``expected_share``, by the memberships of what was chosen, and the facts of the fit: its
    ``residual``, and the ``skill`` and ``accuracy`` of the classifier on held-out documents beside the share of the largest
    source."""
    chosen, facts = _fitted(docs, targets, tokenizer)
    chosen = cut(chosen)
    known = docs.sparkSession.createDataFrame(facts, "mix_name string, source string, i int, residual double, skill double, accuracy double, largest double")
    soft = chosen.select("mix_name", F.posexplode("m").alias("i", "p"), (F.col("n_tokens") * F.col("repeats")).alias("used")).groupBy("mix_name", "i").agg(F.sum(F.col("p") * F.col("used")).alias("e"))
    share = F.round(F.col("e") / F.sum("e").over(Window.partitionBy("mix_name")), 6)
    soft = soft.join(F.broadcast(known), ["mix_name", "i"]).select("mix_name", "source", share.alias("expected_share"), *[F.round(c, 6).alias(c) for c in ("residual", "skill", "accuracy", "largest")])
    return share_report(chosen, targets).join(soft, ["mix_name", "source"], "left")


def share_report(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix and source: the target share, the share reached, tokens, documents and the most repeats of one."""
    used = chosen.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("repeats").alias("most_repeats"))
    total = used.groupBy("mix_name").agg(F.sum("tokens").alias("all_tokens"))
    aims = targets.groupBy("mix_name", "source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    both = aims.join(used, ["mix_name", "source"], "full").join(total, "mix_name", "left")
    return both.select("mix_name", "source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.round(F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("n_tokens"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), "max_repeats")
