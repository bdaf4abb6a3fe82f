"""Toxicity: a Levenshtein automaton run along the trie of a learned lexicon finds terms and their misspellings; scores of
the words around each hit tell quotation from abuse."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlab.llm import common as C
from rosterlab.llm.bpe import Memory

#: Bound of the labelled sample that lexicon and weights are learned from (rows on average), and of the lexicon.
LABELLED_ROWS, LEXICON_TERMS = 12_000, 400
#: A term has at least so many different surroundings under the label, and so many for each labelled row.
LEAST_CONTEXTS, LEAST_SHARE = 5, 0.01
#: Words on either side of a hit that its context score looks at.
CONTEXT = 6
#: Edits allowed for terms of at least so many letters.
EDITS = ((5, 1), (9, 2))
EDGE = ".,;:!?\"'`()[]{}<>|*_~#$%&-“”‘’«»…"
QUOTES = "\"“”«»"
#: Words that report speech or name a word, and words that address someone.
REPORTING = frozenset("said says say wrote writes called calls word words term quote quoted quotes reported reports replied shouted dit écrit mot sagte schrieb wort dijo escribió palabra".split())
ADDRESS = frozenset("you your you're youre yourself u ur du dich tu te toi vous tú usted".split())


class Lexicon:
    """Terms as a trie, and the Levenshtein automaton of their words: states are sets of (trie node, edits so far).

    The product automaton is built as words are read and kept; most words leave it after a few letters.
    """

    def __init__(self, terms: list[str], harmless: frozenset[str] = frozenset()):
        self.terms, self.harmless = terms, harmless
        self.next: list[dict[str, int]] = [{}]
        self.term: list[int] = [-1]
        self.most: list[int] = [0]  # edits that some term below a node allows
        self.limit = [max([n for least, n in EDITS if len(t) >= least], default=0) for t in terms]
        for i, t in enumerate(terms):
            node = 0
            self.most[0] = max(self.most[0], self.limit[i])
            for c in t:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.term.append(-1)
                    self.most.append(0)
                node = self.next[node][c]
                self.most[node] = max(self.most[node], self.limit[i])
            self.term[node] = i
        self.states: list[dict[tuple[int, int], None]] = []
        self.ids: dict[tuple, int] = {}
        self.moves: list[dict[str, int]] = []
        self.accept: list[tuple[int, int]] = []
        self.start = self._state({(0, 0)})

    def _state(self, places: set[tuple[int, int]]) -> int:
        """The state of a set of places, closed over letters of a term that the word leaves out."""
        best: dict[int, int] = {}
        todo = sorted(places, key=lambda p: p[1])
        while todo:
            node, edits = todo.pop()
            if edits > self.most[node] or best.get(node, 99) <= edits:
                continue
            best[node] = edits
            todo += [(child, edits + 1) for child in self.next[node].values()]
        key = tuple(sorted(best.items()))
        if not key:
            return -1
        if key not in self.ids:
            self.ids[key] = len(self.moves)
            self.moves.append({})
            ends = [(e, self.term[n]) for n, e in key if self.term[n] >= 0 and e <= self.limit[self.term[n]]]
            self.accept.append(min(ends) if ends else (-1, -1))
            self.states.append(dict.fromkeys(key))
        return self.ids[key]

    def _move(self, state: int, letter: str) -> int:
        places = set()
        for node, edits in self.states[state]:
            places.add((node, edits + 1))  # a letter too many
            for c, child in self.next[node].items():
                places.add((child, edits + (c != letter)))
        to = self._state(places)
        if len(self.moves) < 200_000:  # beyond that, moves are computed each time
            self.moves[state][letter] = to
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the nearest term within its edits, or None."""
        state, moves = self.start, self.moves
        for c in word:
            to = moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if state < 0:
                return None
        edits, term = self.accept[state]
        if term < 0 or (edits and word in self.harmless):
            return None
        return term, edits


class Scorer:
    """Features of texts, and their scores under learned weights."""

    def __init__(self, lexicon: Lexicon, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.lexicon, self.mean, self.scale, self.weights = lexicon, mean, scale, weights
        self.memory = Memory(self._judge)

    def __getstate__(self) -> dict:
        return {"terms": self.lexicon.terms, "harmless": self.lexicon.harmless, "model": (self.mean, self.scale, self.weights)}

    def __setstate__(self, state: dict) -> None:
        self.__init__(Lexicon(state["terms"], state["harmless"]), *state["model"])  # type: ignore[misc]

    def _judge(self, words: list[str]) -> list[tuple[int, int] | None]:
        return [self.lexicon.match(w.strip(EDGE)) for w in words]

    def features(self, texts: list[str]) -> np.ndarray:
        """exact hits, misspelled hits, hits per word, hits in quotation, hits with address or shouting, hits near others."""
        cut = [t.lower().split() for t in texts]
        every = set().union(*cut) if cut else set()
        self.memory.learn(every)
        bad = {w for w in every if self.memory[w] is not None}
        out = np.zeros((len(texts), 7))
        for row, words in zip(out, cut, strict=True):
            if bad.isdisjoint(words):
                continue
            at = [i for i, w in enumerate(words) if w in bad]
            quotes = np.cumsum([sum(map(w.count, QUOTES)) for w in words]) if any(q in w for w in words for q in QUOTES) else None
            exact = fuzzy = quoted = cued = near = 0.0
            for k, i in enumerate(at):
                term, edits = self.memory[words[i]]
                weight = 1.0 / (1 + edits)
                around = words[max(0, i - CONTEXT) : i] + words[i + 1 : i + 1 + CONTEXT]
                bare = {w.strip(EDGE) for w in around}
                open_ = quotes is not None and (quotes[i] % 2 == 1 or any(q in words[i] for q in QUOTES))
                in_quote = open_ or not bare.isdisjoint(REPORTING)
                exact += edits == 0
                fuzzy += weight * (edits > 0)
                quoted += in_quote
                cued += not bare.isdisjoint(ADDRESS) or any("!" in w for w in around)
                near += (k > 0 and i - at[k - 1] <= CONTEXT) or (k + 1 < len(at) and at[k + 1] - i <= CONTEXT)
            n = exact + fuzzy
            row[:] = [np.log1p(exact), np.log1p(fuzzy), np.log1p(100 * n / len(words)), quoted / max(n, 1e-9), np.log1p(cued), near / max(n, 1e-9), exact > 0]
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        x = (self.features(texts) - self.mean) / self.scale
        z = np.hstack([x, np.ones((len(x), 1))]) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train_test(key: str = "doc_id") -> F.Column:
    """True for the rows that nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int) -> DataFrame:
    """(key, text, y) of about `rows` labelled documents at most, chosen by a hash of the key.

    The chosen labels are few whatever the tables' size, so they go to the documents and not the other way round.
    """
    labels = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~train_test(key)).groupBy(key).agg(F.max(label).cast("int").alias("y"))
    total = labels.count()
    draw = F.pmod(F.xxhash64(F.lit(17), key), F.lit(1 << 30)) / float(1 << 30)
    chosen = labels.where(draw < min(1.0, rows / max(total, 1)))
    return docs.select(key, text).join(F.broadcast(chosen), key).select(key, F.col(text).alias("t"), "y")


def learn_lexicon(sample: DataFrame, terms: int = LEXICON_TERMS) -> list[str]:
    """Words that mark the positive label, best first.

    A word counts once for each pair of words around it, so a passage that many copies share counts once; it is taken if its
    contexts are ten times as frequent under the label as without it, in enough different surroundings not to be chance.
    """
    pieces = sample.select("y", F.split(F.lower("t"), r"\s+").alias("w")).select("y", F.posexplode("w").alias("at", "raw"), "w")
    bare = F.regexp_replace("raw", r"^[^\p{L}]+|[^\p{L}]+$", "")
    around = F.xxhash64(F.get("w", F.col("at") - 1), F.get("w", F.col("at") + 1))
    contexts = pieces.select("y", bare.alias("word"), around.alias("c")).where("length(word) between 3 and 24").distinct()
    counts = contexts.groupBy("word").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good"))
    totals = sample.agg(F.sum("y").alias("b"), F.count("*").alias("n")).first()
    bad_rows, rows = totals["b"] or 0, totals["n"] or 0
    if not bad_rows or bad_rows == rows:
        return []
    ratio = (F.col("bad") / bad_rows) / ((F.col("good") + 0.5) / (rows - bad_rows))
    least = max(LEAST_CONTEXTS, LEAST_SHARE * bad_rows)
    best = counts.where(F.col("bad") >= least).where(ratio >= 10).select("word", (ratio * F.log1p("bad")).alias("r")).orderBy(F.desc("r"), "word").limit(terms).collect()
    return [r["word"] for r in best]


def learn_harmless(sample: DataFrame, terms: list[str]) -> frozenset[str]:
    """Words within the automaton's reach of a term that unmarked texts use: no misspellings."""
    if not terms:
        return frozenset()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(terms)
        for block in C.blocks(batches, "t"):
            found: list[tuple[str, int]] = []
            for t, y in zip(block.column("t").to_pylist(), block.column("y").to_pylist(), strict=True):
                for w in {w.strip(EDGE) for w in (t or "").lower().split()}:
                    hit = lexicon.match(w)
                    if hit and hit[1]:
                        found.append((w, y))
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int32())], ["w", "y"])

    near = sample.select("t", "y").mapInArrow(run, "w string, y int").groupBy("w").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good"))
    # every such word lies within two edits of at most LEXICON_TERMS terms
    return frozenset(r["w"] for r in near.where("good >= 1 and good * 4 >= bad").collect())


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights (the last is the constant) by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([l2] * (x.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = LABELLED_ROWS) -> Scorer:
    """Lexicon, harmless words and context weights from the labels of rows outside the held-out fifth.

    Without labels of both kinds every score is the share of positive labels (0 without any).
    """
    sample = C.staged(labelled_sample(docs, labels, key, text, label, rows))
    terms = learn_lexicon(sample)
    lexicon = Lexicon(terms, learn_harmless(sample, terms))
    blank = Scorer(lexicon, np.zeros(7), np.ones(7), np.zeros(8))
    shared = docs.sparkSession.sparkContext.broadcast(blank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in C.blocks(batches, "t"):
            x = shared.value.features([t or "" for t in block.column("t").to_pylist()])
            yield pa.RecordBatch.from_arrays([block.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    found = sample.select("y", "t").mapInArrow(run, "y int, x array<double>").collect()
    x, y = np.array([r["x"] for r in found]).reshape(-1, 7), np.array([r["y"] for r in found], float)
    C.release(sample)
    mean, scale = (x.mean(0), np.maximum(x.std(0), 1e-6)) if len(x) else (np.zeros(7), np.ones(7))
    if len(set(y.tolist())) < 2:
        share = np.clip(y.mean() if len(y) else 0.0, 1e-9, 1 - 1e-9)
        return Scorer(lexicon, mean, scale, np.array([0.0] * 7 + [np.log(share / (1 - share))]))
    return Scorer(lexicon, mean, scale, logistic((x - mean) / scale, y))


def score(df: DataFrame, scorer: Scorer, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the score (0 to 1) of every whole text.

    Null and empty texts get the score of a text without hits; other columns stay (an existing `out` is replaced).
    """
    df = df.drop(out)
    shared = df.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in C.blocks(batches, text):
            found = shared.value.scores([t or "" for t in block.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(found, pa.float64())], [*block.schema.names, out])
        shared.value.memory.forget()  # the worker lives on and runs other operators
        C.give_back()

    return df.mapInArrow(run, C.widened(df, **{out: "double"}))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, fit(docs, C.table(spark, sf_dir, "labels")))
    return found.select("doc_id", train_test().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
