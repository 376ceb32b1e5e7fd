"""A toxicity classifier with counterfactual regularisation.

The score of a text is the logistic function of a sum over its distinct words; a word's part is the
sum of the weights of its features: the word itself and its first 3 to 6 letters. Weights are
learned from labelled documents with an L1 penalty and a counterfactual one: identity terms in
labelled sentences are swapped for other terms of their kind, and the square of the change in score
is penalised, so that the mention of a group alone moves no score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.llm.common import text_slices

#: Identity terms by kind; a term is swapped for others of its kind.
IDENTITY = {
    "faith": "muslim muslims christian christians jewish jew jews hindu buddhist catholic atheist muslime christen juden musulman chrétien juif musulmán cristiano judío".split(),
    "origin": "african american asian european mexican indian arab chinese german french spanish immigrant immigrants refugee refugees ausländer einwanderer étranger immigré extranjero inmigrante".split(),
    "colour": "black white brown schwarz weiß noir blanc negro blanco".split(),
    "gender": "woman women man men girl boy female male transgender trans frau mann femme homme mujer hombre".split(),
    "orientation": "gay lesbian straight bisexual queer homosexual heterosexual schwul lesbisch lesbienne lesbiana".split(),
    "body": "blind deaf disabled old young behindert taub sourd aveugle ciego sordo".split(),
}
_LETTERS = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """The word, marked as whole, and its prefixes of 3 to 6 letters."""
    return ["=" + word, *[word[:n] for n in range(3, min(6, len(word)) + 1)]]


def words(text: str) -> set[str]:
    return set(_LETTERS.findall(text.lower()))


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from; a row without doc_id isn't held out, but has no label either."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(y: np.ndarray, col: np.ndarray, sizes: np.ndarray, swaps: list[tuple[list[int], list[int], float]], size: int, *, l1: float, counterfactual: float, steps: int = 500, held: int = 1 << 20) -> tuple[np.ndarray, float]:
    """Weights of size features and the bias, by accelerated proximal gradient steps.

    y: label of each document; col: the features of all documents in a row, sizes of them each. swaps:
    features lost and gained by a swap, and how often labelled sentences offer it. Columns are scaled
    to one length; l1 counts in standard deviations of the gradient that a feature without any bearing
    on the label would have. About held features are worked on at a time.
    """
    n = len(y)
    ends = np.cumsum(sizes)
    cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(held, ends[-1] if n else 0, held)), [n]]))
    blocks = [(a, b, col[(ends[a - 1] if a else 0) : ends[b - 1]], sizes[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    counts = np.zeros(size, np.int64)
    for *_, own, _ in blocks:
        counts += np.bincount(own, minlength=size)
    scale = 1 / np.sqrt(np.maximum(counts, 1) / n)
    weight = np.array([s[2] for s in swaps], dtype=float)
    weight = weight / max(weight.sum(), 1)
    s_at = np.repeat(np.arange(len(swaps)), [len(a) + len(b) for a, b, _ in swaps])
    s_col = np.array([c for a, b, _ in swaps for c in [*a, *b]], dtype=np.int64)
    s_value = np.array([x for a, b, _ in swaps for x in [-1.0] * len(a) + [1.0] * len(b)]) * (scale[s_col] if len(s_col) else 1)

    def times(u: np.ndarray) -> np.ndarray:
        out, scaled = np.zeros(n), scale * u
        for a, b, own, each in blocks:
            full = each > 0
            if full.any():
                out[a:b][full] = np.add.reduceat(scaled[own], (np.cumsum(each) - each)[full])
        return out

    def back(e: np.ndarray) -> np.ndarray:
        out = np.zeros(size)
        for a, b, own, each in blocks:
            out += np.bincount(own, np.repeat(e[a:b], each), minlength=size)
        return scale * out

    def swapped(u: np.ndarray) -> np.ndarray:
        """Gradient of half the mean square of the changes that swaps make."""
        change = np.bincount(s_at, s_value * u[s_col], minlength=len(swaps))
        return np.bincount(s_col, s_value * (weight * change)[s_at], minlength=size)

    share = y.mean()
    least = l1 * (share * (1 - share) / n) ** 0.5
    u, bias = np.ones(size), float(np.log(share / (1 - share)))
    steepest = 1.0
    for _ in range(30):  # power iterations for the step
        u = 0.25 * back(times(u)) / n + counterfactual * swapped(u)
        steepest = float(np.linalg.norm(u)) or 1.0
        u /= steepest
    rate = 1 / (1.1 * steepest + 0.25)
    u, momentum = np.zeros(size), 1.0
    v, v_bias = u, bias
    for _ in range(steps):
        error = 1 / (1 + np.exp(-np.clip(v_bias + times(v), -40, 40))) - y
        new = v - rate * (back(error) / n + counterfactual * swapped(v))
        new = np.sign(new) * np.maximum(np.abs(new) - rate * least, 0)
        new_bias = v_bias - rate * error.mean()
        grown = (1 + (1 + 4 * momentum * momentum) ** 0.5) / 2
        pull = (momentum - 1) / grown
        v, v_bias = new + pull * (new - u), new_bias + pull * (new_bias - bias)
        u, bias, momentum = new, new_bias, grown
    return u * scale, bias


def train(docs: DataFrame, labels: DataFrame, *, max_rows: int = 40_000, min_docs: int = 3, max_candidates: int = 60_000, max_features: int = 8192, l1: float = 0.7, counterfactual: float = 1.0) -> tuple[dict[str, float], float]:
    """Feature weights and bias from at most about max_rows labelled documents outside the held-out fold.

    Rows are chosen by a hash of doc_id. Candidates are features of min_docs toxic documents or more,
    at most max_candidates by their number; of them the max_features that tell the labels apart best
    take part. Several labels of one document count as toxic if one does. Without labels of both
    kinds there are no weights and the bias gives the share of toxic ones.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out(F.col("doc_id")))
    total = known.count()
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, max_rows / max(total, 1)))
    chosen = known.where(part).withColumnRenamed("doc_id", "_id")
    # at most about max_rows ids
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("text", "toxic").where("text is not null")

    def counted(keep: set[str] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
            docs_seen: Counter = Counter()
            for batch in text_slices(batches):
                for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
                    docs_seen[int(toxic > 0)] += 1
                    if keep is None and not toxic:
                        continue
                    found = {f for w in words(text) for f in features(w)}
                    seen[int(toxic > 0)].update(found if keep is None else found & keep)
            names = list(set(seen[0]) | set(seen[1]))
            columns = [pa.array([*names, ""]), pa.array([*(seen[1][x] for x in names), docs_seen[1]], pa.int64()), pa.array([*(seen[0][x] for x in names), docs_seen[0]], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["feature", "pos", "neg"])

        return sample.mapInArrow(run, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))

    first = counted(None)
    top = first.where((F.col("pos") >= min_docs) | (F.col("feature") == "")).orderBy(F.desc("pos"), "feature").limit(max_candidates).collect()
    names = {r.feature for r in top} - {""}
    pos, neg = next(((r.pos, r.neg) for r in top if r.feature == ""), (0, 0))
    if not pos or not neg:
        return {}, float(np.log((pos + 0.5) / (neg + 0.5))) if pos + neg else -20.0
    share = pos / (pos + neg)
    gain = lambda r: (r.pos - (r.pos + r.neg) * share) / ((r.pos + r.neg) * share * (1 - share)) ** 0.5
    told = sorted(((gain(r), r.feature) for r in counted(names).collect() if r.feature and r.pos), reverse=True)
    place = {f: i for i, (g, f) in enumerate(told[:max_features]) if g > 3}
    kinds = {t: k for k, terms in IDENTITY.items() for t in terms}

    def chosen_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            found = [words(t) for t in batch["text"].to_pylist()]
            own = [sorted({place[f] for w in ws for f in features(w) if f in place}) for ws in found]
            terms = [sorted(ws & kinds.keys()) for ws in found]
            order = [zlib.crc32(np.array(x, np.int32).tobytes()) for x in own]  # so that reruns add up alike
            yield pa.RecordBatch.from_arrays([batch["toxic"].cast(pa.int32()), pa.array(order, pa.int64()), pa.array(own, pa.list_(pa.int32())), pa.array(terms, pa.list_(pa.string()))], ["toxic", "order", "own", "terms"])

    rows = sample.mapInArrow(chosen_features, "toxic int, order long, own array<int>, terms array<string>").toArrow()
    rows = rows.sort_by([("toxic", "ascending"), ("order", "ascending")]).combine_chunks()
    offered = {x["values"].as_py(): x["counts"].as_py() for x in rows["terms"].combine_chunks().flatten().value_counts()}
    own = rows["own"].combine_chunks()
    labelled = (np.asarray(rows["toxic"]) > 0).astype(float), np.asarray(own.flatten()), np.diff(np.asarray(own.offsets))
    of = lambda t: [place[f] for f in features(t) if f in place]
    swaps = [(of(a), of(b), 1.0 + offered.get(a, 0)) for terms in IDENTITY.values() for a in terms for b in terms if a != b and (of(a) or of(b))]
    w, bias = fit(*labelled, swaps, len(place), l1=l1, counterfactual=counterfactual)
    return {f: float(w[i]) for f, i in place.items() if w[i]}, bias


def score(docs: DataFrame, model: tuple[dict[str, float], float], *, threshold: float = 0.3, cache: int = 500_000) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, score, predicted. A null text is empty and scored so."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most max_features weights
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        parts: dict[str, float] = {}
        for batch in text_slices(batches):
            logits = []
            for text in batch["text"].to_pylist():
                found = words(text)
                for w in found.difference(parts):
                    parts[w] = sum([weights.get(f, 0.0) for f in features(w)])
                logits.append(bias + sum(sorted([x for w in found if (x := parts[w])])))
                if len(parts) > cache:
                    parts.clear()
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(1 / (1 + np.exp(-np.clip(np.array(logits, dtype=float), -40, 40))))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, **options) -> DataFrame:
    """Learns from labels (doc_id, toxic) of docs and scores every row of docs."""
    return score(docs, train(docs, labels, **options), threshold=threshold)
