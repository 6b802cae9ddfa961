"""Language identification by cross-parsing: suffix automata of labelled text, fewest normalised phrases win."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.llm.common import steps, table

#: symbols between automaton lookups start anew: a phrase ends at the end of a segment of so many symbols
SEGMENT = 4096
#: symbols that match nothing (letters the model has not seen), and what stands for any run of non-letters
UNSEEN, GAP = 0, 1
#: cells of all step tables (four bytes each); languages of the most letters look their edges up instead once they are full
CELLS = 1 << 26
UNDETERMINED = "und"


def letters() -> np.ndarray:
    """For each code point the code point of its lower case if it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


_LETTERS: list[np.ndarray] = []


def symbols(text: str, alphabet: np.ndarray) -> np.ndarray:
    """Lower-cased letters as symbols of the alphabet (a map of code points), each run of other characters as one GAP."""
    if not _LETTERS:
        _LETTERS.append(letters())
    cps = _LETTERS[0][np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    sym = np.where(cps == 0, GAP, alphabet[cps]).astype(alphabet.dtype)
    gap = sym == GAP
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    return sym[keep]


def suffix_automaton(texts: list[list[int]]) -> tuple[list[dict[int, int]], int]:
    """Transitions of the automaton that accepts every substring of every text (none across two texts)."""
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    for text in texts:
        last = 0
        for c in text:
            if c in nxt[last]:
                q = nxt[last][c]
                if length[q] == length[last] + 1:
                    last = q
                    continue
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[last] + 1)
                link.append(link[q])
                link[q] = clone
                p = last
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                last = clone
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = link[cur] = clone
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
            last = cur
    return nxt, len(nxt)


@dataclass
class Model:
    """Automata of all languages as one list of edges; small enough to broadcast (a bounded sample of text)."""

    langs: list[str]
    alphabet: dict[int, int]
    edges: list[np.ndarray]
    states: list[int]
    sizes: list[int]

    @cached_property
    def width(self) -> int:
        return max(self.alphabet.values(), default=GAP) + 1

    @cached_property
    def alphabet_map(self) -> np.ndarray:
        out = np.zeros(0x110000, np.int32)
        for cp, s in self.alphabet.items():
            out[cp] = s
        return out

    @cached_property
    def own(self) -> list[np.ndarray]:
        """For each language its own number of each symbol: 1 on for those its root knows, 0 for all others."""
        out = []
        for e in self.edges:
            known = np.unique(e[e[:, 0] == 0, 1])
            numbers = np.zeros(self.width, np.int32)
            numbers[known] = np.arange(1, len(known) + 1)
            out.append(numbers)
        return out

    @cached_property
    def uniform_bits(self) -> list[float]:
        """Bits a letter costs in a uniform code of each language's own letters."""
        return [math.log2(max(int(o.max()), 2)) for o in self.own]

    @cached_property
    def tabled(self) -> list[bool]:
        """Whether a language has a step table: those of the fewest cells, as far as CELLS goes."""
        cells = [n * (int(o.max()) + 1) for n, o in zip(self.states, self.own)]
        order = np.argsort(cells, kind="stable")
        fits = np.zeros(len(cells), bool)
        fits[order] = np.cumsum(np.array(cells, np.int64)[order]) <= CELLS
        return fits.tolist()

    @cached_property
    def dense(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One step of the parse per (state, symbol): four times the next row, plus the phrases that end with the step.

        Without a transition the open phrase ends and the symbol opens the next one; a symbol that even the root does
        not know is a phrase of its own. Every language has rows of its own width; its numbers of the symbols come last.
        """
        starts, parts, base = [], [np.zeros(0, np.int32)], 0
        numbers = [o for o, t in zip(self.own, self.tabled) if t]
        for own, e, n in [x[:3] for x in zip(self.own, self.edges, self.states, self.tabled) if x[3]]:
            w = int(own.max()) + 1
            root = np.full(w, -1, np.int64)
            at_root = e[e[:, 0] == 0]
            root[own[at_root[:, 1]]] = at_root[:, 2]
            miss = root < 0
            step = np.empty((n, w), np.int32)
            step[:] = ((np.where(miss, 0, root) * w + base) * 4 + miss + 1).astype(np.int32)
            step[0] = np.where(miss, base * 4 + 1, 0)
            step[e[:, 0], own[e[:, 1]]] = (e[:, 2].astype(np.int64) * w + base) * 4
            parts.append(step.ravel())
            starts.append(base)
            base += n * w
        return np.concatenate(parts), np.array(starts, np.int32), np.array(numbers, np.int32).reshape(len(starts), self.width)

    def _looked_up(self, language: int, lanes: np.ndarray, active: np.ndarray) -> np.ndarray:
        """Phrases of each lane against a language whose edges are looked up in a sorted list."""
        w, e = self.width, self.edges[language].astype(np.int64)
        key = e[:, 0] * w + e[:, 1]
        order = np.argsort(key)
        key, to = key[order], e[order, 2]
        root = np.zeros(w, np.int64)
        root[e[e[:, 0] == 0, 1]] = e[e[:, 0] == 0, 2]  # no edge leads to the root: 0 stands for an unknown symbol
        state, count = np.zeros(lanes.shape[1], np.int64), np.zeros(lanes.shape[1], np.int64)
        for t, k in enumerate(active):
            sym, at = lanes[t, :k], state[:k]
            want = at * w + sym
            i = np.minimum(np.searchsorted(key, want), len(key) - 1)
            hit = key[i] == want
            begun = root[sym]
            count[:k] += np.where(hit, 0, (at != 0) * 1 + (begun == 0))
            state[:k] = np.where(hit, to[i], begun)
        return count + (state != 0)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text against each language, all segments side by side."""
        dense, starts, numbers = self.dense
        out = np.zeros((len(texts), len(self.edges)), np.int64)
        owner, at, size = [], [], []
        for i, x in enumerate(texts):
            for a in range(0, len(x), SEGMENT):
                owner.append(i), at.append(a), size.append(min(SEGMENT, len(x) - a))
        if not owner:
            return out
        order = np.argsort(-np.array(size), kind="stable")
        size = np.array(size)[order]
        lanes = np.zeros((size[0], len(order)), np.int32)
        for lane, k in enumerate(order):
            lanes[: size[lane], lane] = texts[owner[k]][at[k] : at[k] + size[lane]]
        active = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
        state = np.repeat(starts[:, None], len(order), axis=1)
        count = np.zeros(state.shape, np.int32)
        for t in range(size[0]):
            k = active[t]
            v = dense[state[:, :k] + numbers[:, lanes[t, :k]]]
            count[:, :k] += v & 3
            state[:, :k] = v >> 2
        count += state != starts[:, None]
        counts = np.zeros((len(self.edges), len(order)), np.int64)
        counts[np.flatnonzero(self.tabled)] = count
        for language in np.flatnonzero(~np.array(self.tabled, bool)):
            counts[language] = self._looked_up(language, lanes, active)
        np.add.at(out, np.array(owner)[order], counts.T)
        return out

    def judge(self, texts: list[str | None]) -> list[tuple[str, float, float | None]]:
        """(language, score, bits a letter) of each text."""
        syms = [symbols(x, self.alphabet_map) if x else np.zeros(0, np.int32) for x in texts]
        counts = self.phrases(syms) if self.langs else np.zeros((len(texts), 0))
        cost = np.array([math.log2(max(n, 2)) for n in self.sizes])
        out = []
        for x, c in zip(syms, counts):
            if not (x != GAP).any() or not self.langs:
                out.append((UNDETERMINED, 0.0, None))
                continue
            bits = c * cost / len(x)
            best = int(np.argmin(bits))  # languages are in alphabetical order: the first wins a tie
            rest = np.delete(bits, best)
            second = float(rest.min()) if len(rest) else 2 * float(bits[best])
            out.append((self.langs[best], second / (second + float(bits[best])), float(bits[best])))
        return out


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_langs: int = 64, docs_per_lang: int = 60, chars_per_lang: int = 48_000, longest: int = 8_000) -> Model:
    """A model from a bounded sample of labelled rows: at most ``max_langs`` languages (the most frequent), for each about
    ``docs_per_lang`` documents (the first ``longest`` characters of each), chosen by a hash of the id, those of 40 characters or more first, and
    ``chars_per_lang`` symbols of them. All letters of the sample count, in every language its own. Languages of fewer rows give what they have. Rows without label or text are not used; an empty
    table gives a model without languages, which answers ``und``.
    """
    train = docs.selectExpr(f"`{id_col}` AS id", f"substring(`{text_col}`, 1, {longest}) AS text", f"`{lang_col}` AS lang").filter("lang IS NOT NULL AND text <> ''")
    counts = train.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()
    if not counts:
        return Model([], {}, [], [], [])
    rate = {r["lang"]: min(1.0, 2 * docs_per_lang / r["count"]) for r in counts}
    draw = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("language")), F.lit(1 << 40))
    bound = F.create_map(*[x for lang, p in rate.items() for x in (F.lit(lang), F.lit(int(p * (1 << 40))))])
    sample = train.withColumn("draw", draw).filter(F.col("draw") < bound[F.col("lang")]).select("lang", "draw", "text").collect()
    by_lang: dict[str, list[str]] = {lang: [] for lang in sorted(rate)}
    for r in sorted(sample, key=lambda r: (len(r["text"]) < 40, r["draw"], r["text"])):
        by_lang[r["lang"]].append(r["text"])
    by_lang = {k: v[:docs_per_lang] for k, v in by_lang.items() if v}
    seen: Counter[int] = Counter()
    if not _LETTERS:
        _LETTERS.append(letters())
    for texts in by_lang.values():
        for x in texts:
            cps = _LETTERS[0][np.frombuffer(x.encode("utf-32-le", "replace"), np.uint32)]
            seen.update(cps[cps > 0].tolist())
    alphabet = {cp: i + 2 for i, (cp, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0])))}
    model = Model(list(by_lang), alphabet, [], [], [])
    for texts in by_lang.values():
        left, parts = chars_per_lang, []
        for x in texts:
            s = symbols(x, model.alphabet_map)[:left].tolist()
            parts.append(s)
            left -= len(s)
            if left <= 0:
                break
        nxt, n = suffix_automaton(parts)
        model.edges.append(np.array([(a, c, b) for a, row in enumerate(nxt) for c, b in row.items() if c != UNSEEN] or [(0, GAP, 0)], np.int32))
        model.states.append(n)
        model.sizes.append(chars_per_lang - max(left, 0))
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), names: tuple[str, str, str] = ("lang_pred", "score", "bits")) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep`` (the id by default), then lang_pred, score, bits (or other ``names``).

    The text, lower-cased, non-letters collapsed, is cut greedily into the longest phrases that occur in the training
    text of a language. Phrases times log2 of the training length, over the letters, are the bits a letter costs
    (cross-parsing entropy); the cheapest language wins, the alphabetically first on a tie. ``score`` is second / (first +
    second): 0.5 on a tie, near 1 when no other language comes close. Null texts and texts without letters give
    ``und``, score 0 and null bits. Texts are read whole, of any length; repeated rows each get their row.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    keep = keep or (id_col,)
    fields = [*keep] if text_col in keep else [*keep, text_col]
    at = fields.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in steps(batches, text_col):
            got = m.judge(b.column(at).to_pylist())
            extra = [pa.array([g[i] for g in got], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *extra], [*keep, *names])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    out = ", ".join(f"`{n}` {kind}" for n, kind in zip(names, ("string", "double", "double")))
    return docs.select(*[F.col(f"`{c}`") for c in fields]).mapInArrow(run, f"{kinds}, {out}")


def held_out(id_col: str = "doc_id", mod: int = 4, rest: int = 2):
    """Whether crc32 of the id as text leaves ``rest``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % mod == rest, F.lit(False))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.filter(~held_out()))
    return identify(docs.select("doc_id", "text", held_out().alias("held_out")), model, keep=("doc_id", "held_out"))


QUERIES = {"op1_language_id": op1}
ORACLES: dict[str, str] = {}
