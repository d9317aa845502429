"""Mixing sources to target weights by cube-method balanced sampling.

Every text of a source gets the same number of copies in expectation. Its whole part is taken by all texts; the
fractional part is decided by the cube method: inclusion probabilities move through the null space of the balancing
constraints (number of documents, number of tokens) until nearly all are 0 or 1. This flight runs in blocks of bounded
size; what each block leaves undecided meets in fewer blocks, until a handful per source is landed.
"""

from __future__ import annotations

import base64
import bisect
import math
import random
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delvework.session import checkpointed

#: Texts whose flight runs in one task at a time; each block leaves two of them undecided at most.
BLOCK = 1024
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
EPS = 1e-9
#: Sources up to which what is known of them is sent to all tasks.
FEW = 100_000


def flight(pi: list[float], size: list[float], rng: random.Random) -> list[float]:
    """Flight phase with two constraints, the sum of ``pi`` and of ``pi * size``: at most two stay between 0 and 1.

    Three undecided texts at a time have exactly one direction in which neither sum changes; a random step along it,
    unbiased in expectation, decides at least one of them.
    """
    pi = list(pi)
    scale = max(map(abs, size), default=1.0) or 1.0
    live: list[int] = []
    rest = iter(range(len(pi)))
    while True:
        while len(live) < 3:
            i = next(rest, None)
            if i is None:
                return pi
            if EPS < pi[i] < 1 - EPS:
                live.append(i)
            else:
                pi[i] = float(round(pi[i]))
        a, b, c = (size[i] / scale for i in live)
        u = (c - b, a - c, b - a)  # orthogonal to (1, 1, 1) and to the sizes
        if max(map(abs, u)) < 1e-12:
            u = (1.0, -1.0, 0.0)
        up = min((1 - pi[i]) / d if d > 0 else pi[i] / -d for i, d in zip(live, u) if abs(d) > 1e-15)
        down = min(pi[i] / d if d > 0 else (1 - pi[i]) / -d for i, d in zip(live, u) if abs(d) > 1e-15)
        step = up if rng.random() * (up + down) < down else -down
        for i, d in zip(live, u):
            pi[i] = min(1.0, max(0.0, pi[i] + step * d))
            if pi[i] <= EPS or pi[i] >= 1 - EPS:
                pi[i] = float(round(pi[i]))
        live = [i for i in live if EPS < pi[i] < 1 - EPS]


def landing(pi: list[float], size: list[float], start: list[float]) -> list[float]:
    """Decides the few texts that the flight left, then exchanges up to three pairs of decided ones.

    ``start`` holds the probabilities before the flight; both steps bring the size of what is taken closest to theirs.
    """
    want = sum(p * s for p, s in zip(start, size))
    out = [float(round(p)) for p in pi]
    open_ = [i for i, p in enumerate(pi) if EPS < p < 1 - EPS]
    rest = want - sum(o * s for i, (o, s) in enumerate(zip(out, size)) if i not in open_)
    best = min(range(1 << len(open_)), key=lambda m: (abs(sum(size[i] for k, i in enumerate(open_) if m >> k & 1) - rest), m))
    for k, i in enumerate(open_):
        out[i] = float(best >> k & 1)
    free = [i for i, p in enumerate(start) if EPS < p < 1 - EPS]
    for _ in range(3):
        miss = want - sum(o * s for o, s in zip(out, size))
        inside = [i for i in free if out[i] == 1]
        outside = sorted((size[j], j) for j in free if out[j] == 0)
        if not inside or not outside or abs(miss) < 1:
            break
        found = (abs(miss), -1, -1)
        for i in inside:
            k = bisect.bisect_left(outside, (size[i] + miss, -1))
            for s, j in outside[max(0, k - 1) : k + 1]:
                found = min(found, (abs(miss - (s - size[i])), i, j))
        if found[1] < 0:
            break
        out[found[1]], out[found[2]] = 0.0, 1.0
    return out


def _counted(ranks_ref):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        # a plain splitting pattern: words with the blank before them, numbers, marks, white space
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        enc = tiktoken.Encoding("mix", pat_str=pattern, mergeable_ranks=ranks_ref.value, special_tokens={})
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) for t in batch.column("text").to_pylist()]
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(n, pa.int64())], names=[*keep, "tokens"])

    return run


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, text_id, tokens``: clean source names, a hash of the text, and its length in tokens.

    The tokenizer's file is read here and sent along: it has one line per token, so its size is that of a vocabulary.
    """
    with open(tokenizer, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    ref = documents.sparkSession.sparkContext.broadcast(ranks)
    d = documents.where("doc_id IS NOT NULL AND text IS NOT NULL AND source IS NOT NULL")
    d = d.select("doc_id", F.lower(F.trim("source")).alias("source"), F.md5("text").alias("text_id"), "text")
    return d.mapInArrow(_counted(ref), "doc_id long, source string, text_id string, tokens long")


def _flown(undecided: DataFrame, blocks: DataFrame, seed: int, last: bool) -> DataFrame:
    """``source, doc_id, tokens, pi`` after a flight in each block of a source; landed as well if ``last``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        rng = random.Random(f"{seed}/{pdf['source'].iat[0]}/{pdf['block'].iat[0]}/{last}")
        order = list(range(len(pdf)))
        rng.shuffle(order)
        pi, size = pdf["pi"].tolist(), pdf["tokens"].astype(float).tolist()
        got = flight([pi[i] for i in order], [size[i] for i in order], rng)
        if last:
            got = landing(got, [size[i] for i in order], [pi[i] for i in order])
        out = [0.0] * len(order)
        for i, p in zip(order, got):
            out[i] = p
        return pd.DataFrame({"source": pdf["source"], "doc_id": pdf["doc_id"], "tokens": pdf["tokens"], "pi": out})

    # the last blocks are one per source, whatever their number of texts (at most BLOCK, as counted before)
    b = undecided.join(blocks, "source").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("n_blocks")).cast("int"))
    return b.select("source", "block", "doc_id", "tokens", "pi").groupBy("source", "block").applyInPandas(run, "source string, doc_id long, tokens long, pi double")


def mix(documents: DataFrame, mix_targets: DataFrame, total: int | None = None, seed: int = 7, tokenizer: str = TOKENIZER, block: int = BLOCK) -> DataFrame:
    """``doc_id, source, tokens, copies, target_share``: the texts of the mix and how often each is used.

    Sources are compared without case and padding. Equal texts are one text: it counts for the source of its lowest
    doc_id, which represents it, and is used at most ``max_repeats`` times. ``total`` is the size of the mix in tokens;
    the default, which is also its upper bound, is the largest at which no source must be repeated more often than
    allowed. Shares of sources without any tokens can't be met; they go to the others in proportion. Documents with
    null id, text or source, of sources without target, and empty texts are not used; targets with null source, share
    or repeats or without a positive share are ignored; a source named twice counts with its largest share.
    """
    spark = documents.sparkSession
    targets = mix_targets.where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").groupBy(F.lower(F.trim("source")).alias("source")).agg(
        F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")
    )
    counted = token_counts(documents, tokenizer).groupBy("text_id").agg(F.min(F.struct("doc_id", "source", "tokens")).alias("r")).select("r.*").where("tokens > 0")
    # one row per source: sent where there are few, as counted
    few = targets.count() <= FEW

    def sent(one_per_source: DataFrame) -> DataFrame:
        return F.broadcast(one_per_source) if few else one_per_source

    texts = checkpointed(counted.join(sent(targets), "source"))
    per = texts.groupBy("source").agg(F.sum("tokens").alias("have"), F.count("*").alias("n"), F.first("target_share").alias("p"), F.first("max_repeats").alias("m"))
    per = checkpointed(per)
    lim = per.agg(F.sum("p").alias("p"), F.min(F.col("have") * F.col("m") / F.col("p")).alias("t")).first()
    if not lim.p:
        return spark.createDataFrame([], "doc_id long, source string, tokens long, copies long, target_share double")
    size = lim.t * lim.p if total is None else min(float(total), lim.t * lim.p)
    plan = per.select("source", "n", F.least(F.col("m").cast("double"), F.lit(size / lim.p) * F.col("p") / F.col("have")).alias("each"))
    # a plan of one row per source: as many as there are targets with texts
    plan = plan.select("source", "n", F.floor(F.col("each") + EPS).alias("whole"), F.greatest(F.lit(0.0), F.col("each") - F.floor(F.col("each") + EPS)).alias("pi"))
    units = texts.join(sent(plan), "source").select("doc_id", "source", "tokens", "target_share", "whole", "pi")
    undecided = units.where(F.col("pi") > EPS).select("source", "doc_id", "tokens", "pi")
    most = per.agg(F.max("n")).first()[0]
    counts = per.select("source", F.col("n").cast("long").alias("left"))
    decided = None
    level = 0
    while True:
        last = most <= block
        blocks = counts.select("source", F.greatest(F.lit(1), F.ceil(F.col("left") / block)).alias("n_blocks"), "left")
        flown = checkpointed(_flown(undecided, sent(blocks.select("source", "n_blocks")), seed + level, last))
        done = flown.where(~F.col("pi").between(EPS, 1 - EPS)).select("doc_id", F.col("pi").cast("long").alias("extra"))
        decided = done if decided is None else decided.unionByName(done)
        if last:
            break
        # each block leaves two texts at most
        counts = blocks.select("source", (F.col("n_blocks") * 2).alias("left"))
        most = 2 * math.ceil(most / block)
        undecided = flown.where(F.col("pi").between(EPS, 1 - EPS))
        level += 1
    out = units.join(decided, "doc_id", "left").withColumn("copies", F.col("whole") + F.coalesce("extra", F.lit(0)))
    return out.where("copies > 0").select("doc_id", "source", "tokens", F.col("copies").cast("long").alias("copies"), "target_share")


def shares(mixed: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """``source, target_share, actual_share, tokens, texts, copies, most_copies``: one row per source of the targets."""
    per = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("texts"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"))
    whole = per.agg(F.sum("tokens").alias("whole"))
    t = mix_targets.where("source IS NOT NULL").groupBy(F.lower(F.trim("source")).alias("source")).agg(F.max("target_share").alias("target_share"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tokens", "texts", "copies", "most_copies")]
    # one row beside each source, no join of rows with rows
    out = t.join(per, "source", "left").join(F.broadcast(whole), how="left")
    return out.select("source", "target_share", F.round(F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)), 6).alias("actual_share"), *zero)
