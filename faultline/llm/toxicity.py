"""Toxicity by a weighted lexicon: folded text, Aho-Corasick matching, exception phrases, length-normalised scores."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.llm.common import steps, table

# Letters of other scripts that look like Latin ones, and digits and signs used in place of letters.
# The letters i and l fold together, as both are written 1.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "х": "x", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ɑ": "a", "ɡ": "g", "ı": "i", "ℓ": "l",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "l": "i", "|": "i"}
INVISIBLE = "­​‌‍⁠﻿"
SPACE = 32

_FOLD: list[np.ndarray] = []


def folding() -> np.ndarray:
    """For each code point what it folds to: a lower-case letter, a space for all that is no letter, 0 to drop it."""
    if not _FOLD:
        out = np.full(0x110000, SPACE, np.uint32)
        for cp in range(0x30000):
            c = chr(cp)
            if 0xFF01 <= cp <= 0xFF5E:  # full-width forms
                c = chr(cp - 0xFEE0)
            low = c.lower()
            low = low if len(low) == 1 else c
            low = HOMOGLYPHS.get(low, low)
            low = DIGITS.get(low, low)
            if low.isalpha():
                out[cp] = ord(low)
        for c in INVISIBLE:
            out[ord(c)] = 0
        _FOLD.append(out)
    return _FOLD[0]


def fold(text: str) -> str:
    """Folded text: words of letters, one space between, before and after them."""
    cps = folding()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    cps = cps[cps != 0]
    keep = cps != SPACE
    if len(keep):
        keep[1:] |= cps[:-1] != SPACE
    return f" {cps[keep].tobytes().decode('utf-32-le').strip()} "


@dataclass
class Lexicon:
    """Word beginnings and whole words with their weights, exception phrases, and the curve from hits to a score."""

    weights: dict[str, float]  # a key that ends in a space is a whole word, others are how a word begins
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, float, float] = (-4.0, 0.0, 0.0)

    @cached_property
    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for key, w in self.weights.items():
            a.add_word(f" {key}", (len(key), w, False))
        for phrase in self.exceptions:
            key = fold(phrase)
            a.add_word(key, (len(key) - 2, 0.0, True))
        a.make_automaton()
        return a

    def hits(self, folded: str) -> list[tuple[int, str, float]]:
        """(start, entry, weight) of the hits outside exception phrases, for each word the longest entry."""
        if not self.weights:
            return []
        excused: list[tuple[int, int]] = []
        found: dict[int, tuple[int, float]] = {}
        for end, (n, w, exception) in self.automaton.iter(folded):
            if exception:
                excused.append((end - n, end))
            else:
                start = end - n + 1
                if start not in found or found[start][0] < n:
                    found[start] = (n, w)
        return [(s, folded[s : s + n], w) for s, (n, w) in sorted(found.items()) if not any(a <= s < b for a, b in excused)]

    def features(self, folded: str) -> tuple[float, float]:
        """Weight of the hits, and weight of the hits for each hundred words."""
        total = sum(w for _, _, w in self.hits(folded))
        words = max(folded.count(" ") - 1, 1)
        return math.log1p(total), math.log1p(100 * total / words)

    def score(self, text: str | None) -> float:
        a, b = self.features(fold(text)) if text else (0.0, 0.0)
        z = self.curve[0] + self.curve[1] * a + self.curve[2] * b
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fragments(folded: str, shortest: int = 4, longest: int = 7) -> set[str]:
    """The words of a text (with a space behind) and the beginnings of its longer words."""
    words = set(folded.split())
    out = {f"{w} " for w in words}
    for n in range(shortest, longest + 1):
        out |= {w[:n] for w in words if len(w) > n}
    return out


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Weighted logistic regression with a constant, by Newton steps; no feature may lower the score.

    Of the subsets of features whose coefficients all come out positive the likeliest is taken, the others count zero.
    """
    best, least = np.zeros(1 + x.shape[1]), math.inf
    for chosen in range(1 << x.shape[1]):
        use = [0, *(k + 1 for k in range(x.shape[1]) if chosen >> k & 1)]
        a = np.column_stack([np.ones(len(x)), x])[:, use]
        beta = np.zeros(len(use))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
            h = (a * (weight * p * (1 - p) + 1e-9)[:, None]).T @ a + ridge * np.eye(len(beta))
            step = np.clip(np.linalg.solve(h, a.T @ (weight * (y - p)) - ridge * beta), -5, 5)
            beta += step
            if np.abs(step).max() < 1e-9:
                break
        z = np.clip(a @ beta, -30, 30)
        loss = float((weight * (np.log1p(np.exp(z)) - y * z)).sum() + ridge / 2 * (beta @ beta))
        if (beta[1:] >= 0).all() and loss < least:
            least, best = loss, np.zeros(1 + x.shape[1])
            best[use] = beta
    return tuple(map(float, best))


def learn(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", docs_per_class: int = 4_000, entries: int = 400, support: int = 4, share: float = 0.01, least_weight: float = 2.5, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """A lexicon from a bounded sample of labelled rows: about ``docs_per_class`` documents of label 1 and of label 0,
    chosen by a hash of the id. Word beginnings and words are weighted by their smoothed log odds; at most ``entries``
    that occur in ``support`` documents of label 1 and in ``share`` of them, and weigh ``least_weight``, are kept,
    beginnings before longer ones that say no more. Pairs of
    words around an entry that occur mostly without the label become exception phrases, beside those given. Labels
    other than 0 and 1 and null texts are not used; without both classes the lexicon is empty and scores stay low.
    """
    spark = docs.sparkSession
    marks = labels.selectExpr(f"`{id_col}` AS id", f"`{label_col}` AS y").filter("id IS NOT NULL AND y IN (0, 1)")
    counts = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Lexicon({}, list(exceptions))
    rate = {y: min(1.0, docs_per_class / n) for y, n in counts.items()}
    draw = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("toxicity")), F.lit(1 << 40))
    chosen = marks.filter(draw < F.when(F.col("y") == 1, int(rate[1] * (1 << 40))).otherwise(int(rate[0] * (1 << 40)))).groupBy("id").agg(F.max("y").alias("y"))
    sample = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").filter("text IS NOT NULL").join(F.broadcast(chosen), "id").select("y", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            by: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by[y].update(fragments(fold(text)))
                by[y]["\n"] += 1
            keys = list(by[0].keys() | by[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([by[0][k] for k in keys], pa.int64()), pa.array([by[1][k] for k in keys], pa.int64())], ["key", "clean", "toxic"])

    sums = sample.mapInArrow(count, "key string, clean bigint, toxic bigint").groupBy("key").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    sums = cut_small(sums.filter((F.col("toxic") >= support) | (F.col("key") == "\n")))
    all_ = next((r for r in sums if r["key"] == "\n"), None)
    if all_ is None or not all_["clean"] or not all_["toxic"]:
        return Lexicon({}, list(exceptions))
    odds = {r["key"]: math.log((r["toxic"] + 0.5) / (all_["toxic"] + 1)) - math.log((r["clean"] + 0.5) / (all_["clean"] + 1)) for r in sums if r["key"] != "\n"}
    seen = {r["key"]: r["toxic"] for r in sums}
    weights: dict[str, float] = {}
    for key in sorted((k for k, w in odds.items() if w >= least_weight and seen[k] >= share * all_["toxic"]), key=lambda k: (-odds[k] * math.sqrt(seen[k]), k)):
        word = key.rstrip(" ")
        if not any(word[:n] in weights and weights[word[:n]] > 0.7 * odds[key] for n in range(4, len(word) + (key != word))):
            weights[key] = odds[key]
        if len(weights) == entries:
            break
    lexicon = Lexicon(weights, list(exceptions))
    shared = spark.sparkContext.broadcast(lexicon)

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        for b in steps(batches):
            ys, a1, b1, pairs = [], [], [], []
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f = fold(text)
                x = lex.features(f)
                ys.append(y), a1.append(x[0]), b1.append(x[1])
                near = set()
                for s, _, _ in lex.hits(f):
                    left, end = f.rfind(" ", 0, s - 1) + 1, f.find(" ", s)
                    right = f.find(" ", end + 1)
                    near |= {f[left:end]} if s > 1 else set()
                    near |= {f[s:right]} if right > 0 else set()
                pairs.append(sorted(near))
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(a1, pa.float64()), pa.array(b1, pa.float64()), pa.array(pairs, pa.list_(pa.string()))], ["y", "a", "b", "pairs"])

    # two columns a sampled document reach the driver; the pairs of words are counted where they are
    near = sample.mapInArrow(around, "y int, a double, b double, pairs array<string>")
    pairs = near.select("y", F.explode("pairs").alias("pair")).groupBy("pair").agg(F.sum(1 - F.col("y")).alias("clean"), F.sum("y").alias("toxic"))
    lexicon.exceptions += [r["pair"] for r in pairs.filter(F.col("clean") >= F.greatest(F.lit(support), 4 * F.col("toxic"))).orderBy(F.desc("clean"), "pair").limit(entries).collect()]
    if len(lexicon.exceptions) > len(exceptions):
        lexicon = Lexicon(weights, lexicon.exceptions)
        shared.unpersist()
        shared = spark.sparkContext.broadcast(lexicon)
        near = sample.mapInArrow(around, "y int, a double, b double, pairs array<string>")
    got = near.select("y", "a", "b").toPandas()
    y = got["y"].to_numpy(float)
    lexicon.curve = fit_curve(got[["a", "b"]].to_numpy(float), y, np.where(y == 1, 1 / rate[1], 1 / rate[0]))
    return Lexicon(lexicon.weights, lexicon.exceptions, lexicon.curve)


def cut_small(df: DataFrame, most: int = 200_000) -> list:
    """Rows of a table that a bounded sample made; more than ``most`` is an error, not a cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows from a bounded sample")
    return rows


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, then score (0 to 1) and hits (how many entries matched outside exceptions), for each row.

    Null and empty texts have no hits and get the score of a text without hits. Whole texts of any length are matched
    in one pass. Repeated rows each get their row, an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        for b in steps(batches, "__text"):
            texts = [fold(x) if x else " " for x in b.column(b.num_columns - 1).to_pylist()]
            scores, hits = [], []
            for f in texts:
                found = lex.hits(f)
                total = sum(w for _, _, w in found)
                z = lex.curve[0] + lex.curve[1] * math.log1p(total) + lex.curve[2] * math.log1p(100 * total / max(f.count(" ") - 1, 1))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
                hits.append(len(found))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores, pa.float64()), pa.array(hits, pa.int64())], [*b.schema.names[:-1], "score", "hits"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, f"{kinds}, score double, hits bigint")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    lexicon = learn(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").filter(~held))
    return score(docs.select("doc_id", held.alias("held_out"), "text"), lexicon, keep=("doc_id", "held_out")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


QUERIES = {"op8_toxicity": op8}
ORACLES: dict[str, str] = {}
