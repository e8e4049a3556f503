"""Toxicity scores from a lexicon met with spelling errors, and from the words around each meeting.

1. Terms are learned from a bounded sample of labelled training rows: words, and beginnings of words, that stand in many toxic texts, between
   different words, and in almost no others; a short list of common insults is added.
2. Words of clean texts of the sample that lie near a term are words of their own, and no misspellings of it. Beyond these, every term has the edits
   that are certified for it: up to one from 5 letters on, two from 9 on, and of these the ones that clean texts hardly meet. Each half of the clean
   sample is read with the words of the other half set aside; the edits met least come first, for as long as all of them together are
   met by at most FALSE_SHARE of the texts. The others are dropped, whatever they would weigh.
3. All terms form one trie. The Levenshtein automata of its terms run over the trie together as one automaton whose states, sets of (node, edits),
   are worked out when first met and then kept: a word is read once, whatever the size of the lexicon, and most words end after a few letters.
   Words that hold no whole piece of a term, of its letters but for the edits, cannot meet one and are not read; a worker keeps its automaton
   from task to task.
4. Every meeting is read in its window: quotation marks around it or words of reporting near it speak for quotation, words of address for abuse. A
   misspelled meeting counts as DISCOUNT of an exact one.
5. A logistic regression, fitted on the sample and weighted back to the labels' own shares, turns counts into a score. The sample is joined by texts made
   from it: toxic ones whose terms are misspelled by one letter, and clean ones in which a term is quoted, of the labels of the texts they are made
   from. Weights are drawn to 0 and keep their signs: meetings, misspelled ones too, never lower a score, and quotation never raises it.

Labels are learned from rows whose crc32 of the doc_id as text leaves a remainder other than 0 by 5; labels, lang, source and doc_id are never
inputs of a score.

Defined cases: null and empty texts have no meetings and get the score of such texts; a null toxic label is left out; of several labels of a
document the largest counts; a null doc_id is scored and never learned from, held_out is null then; without labels of both classes the lexicon is
the short list and the score is 0.9 with two unquoted meetings or more, 0.1 otherwise; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, staged, table

#: Rows of each class to learn from, taken by hash of doc_id.
SAMPLE = 4000
#: Terms of the lexicon at most; texts that a term has to stand in; and how much more often in toxic texts.
MOST_TERMS, LEAST_TEXTS, LEAST_ODDS = 3000, 5, 30.0
#: Of the toxic texts, the share from which on a term need not stand between different words.
LEAST_SHARE = 0.01
#: Share of clean texts that may meet all certified edits together, rounds in which edits are dropped, and what a misspelled meeting counts.
FALSE_SHARE, ROUNDS, DISCOUNT = 0.01, 6, 0.8
#: Lengths of beginnings that are tried as terms.
STEMS = (4, 5, 6, 7)
#: Common insults: fixed values.
INSULTS = ("idiot", "moron", "stupid", "dumbass", "loser", "scum", "worthless", "pathetic", "disgusting", "imbecile", "vermin", "scumbag", "asshole", "bastard", "bitch")
#: Words of address, and of reporting: fixed values.
ADDRESS = frozenset("you your yours youre are u ur du dich dein dir ihr bist tu te ton vous votre es eres tú ti usted".split())
REPORT = frozenset("said says say quote quoted quoting called calls word words term terms wrote writes written reported means meaning sagte nannte wort dit disait mot dijo llamó palabra".split())
QUOTES = "\"'“”‘’«»„‚`"
WORD = re.compile(r"\w[\w@$*]*\w")
WINDOW = 5
#: Words whose meetings a worker remembers, and states of the automaton that it keeps.
REMEMBERED, MOST_STATES = 400_000, 50_000


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Whether a row must not be learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def edits_for(length: int) -> int:
    return 2 if length >= 9 else 1 if length >= 5 else 0


def letters_of(word: str) -> int:
    """The letters of a word as a set of bits; some letters share one."""
    bits = 0
    for c in word:
        bits |= 1 << ord(c) % 61
    return bits


class FuzzyLexicon:
    """Terms in a trie, met by words within the edits that are given for a term, or that its length allows. A stem is met by words that begin with it."""

    def __init__(self, words: dict[str, float], stems: dict[str, float] | None = None, edits: dict[tuple[str, bool], int] | None = None, own: Iterable[str] = ()):
        # by (term, as stem); stems have one edit at most
        self.edits = {(t, kind): (edits or {}).get((t, kind), min(edits_for(len(t)), 1) if kind else edits_for(len(t))) for kind, terms in ((False, words), (True, stems or {})) for t in terms}
        self.child: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.allowed: list[int] = [0]  # most edits of any term at or below a node
        self.weight = {**(stems or {}), **words}
        for kind, terms in ((self.term, words), (self.stem, stems or {})):
            for text in terms:
                node, edits = 0, self.edits[text, kind is self.stem]
                self.allowed[0] = max(self.allowed[0], edits)
                for c in text:
                    if c not in self.child[node]:
                        self.child[node][c] = len(self.child)
                        self.child.append({}), self.term.append(None), self.stem.append(None), self.allowed.append(0)
                    node = self.child[node][c]
                    self.allowed[node] = max(self.allowed[node], edits)
                kind[node] = text
        self.own = frozenset(own)  # words near a term that are none of its misspellings
        self.beginnings = tuple(stems or {})
        self.pieces = self._pieces(words)
        # a word that begins with a stem but for one edit has one half of it whole
        halves = [(a, t[cut:end]) for t in stems or {} if self.edits[t, True] for cut, end in ((0, len(t) // 2), (len(t) // 2, len(t))) for a in ([0] if not cut else range(cut - 1, cut + 2))]
        self.halves = [(a, a + n, frozenset(h for b, h in halves if b == a and len(h) == n)) for a, n in sorted({(a, len(h)) for a, h in halves})]
        self.reset()

    def _pieces(self, words: Iterable[str]) -> dict[int, list[tuple[int, int, dict[str, tuple[tuple[int, int], ...]]]]]:
        """For each length of a word its slices and what they hold in a word that meets a term, with the term's letters and edits.

        A term is cut into one piece more than it has edits, so that one piece is left whole: the first where it was, the last at the word's
        end, or the middle one between an edit on either side.
        """
        found: dict[int, dict] = defaultdict(lambda: defaultdict(lambda: defaultdict(set)))
        for text in words:
            size, edits = len(text), self.edits[text, False]
            cuts = [size * k // (edits + 1) for k in range(edits + 2)]
            for n in range(size - edits, size + edits + 1):
                for k in range(edits + 1):
                    piece = text[cuts[k] : cuts[k + 1]]
                    for a in [0] if k == 0 else [n - len(piece)] if k == edits else range(cuts[k] - 1, cuts[k] + 2):
                        found[n][a, a + len(piece)][piece].add((letters_of(text), edits))
        return {n: [(a, b, {piece: tuple(terms) for piece, terms in held.items()}) for (a, b), held in slices.items()] for n, slices in found.items()}

    def may_meet(self, word: str) -> bool:
        """False for words that meet no term: what is left is read."""
        letters = None
        for a, b, held in self.pieces.get(len(word), ()):
            terms = held.get(word[a:b])
            if terms is not None:
                letters = letters_of(word) if letters is None else letters
                for own, edits in terms:
                    if (letters & ~own).bit_count() <= edits and (own & ~letters).bit_count() <= edits:
                        return True
        return word.startswith(self.beginnings) or any(word[a:b] in held for a, b, held in self.halves)

    def reset(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[dict[int, int]] = []
        self.next: list[dict[str, int]] = []
        self.ends: list[tuple[str, int] | None] = []
        self.starts: list[tuple[int, str] | None] = []
        self.first = self._state(self._skipped({0: 0}))

    def _skipped(self, nodes: dict[int, int]) -> dict[int, int]:
        """nodes and those reached by leaving letters of terms out."""
        out, todo = dict(nodes), list(nodes)
        while todo:
            node = todo.pop()
            for below in self.child[node].values():
                e = out[node] + 1
                if e <= self.allowed[below] and e < out.get(below, 9):
                    out[below] = e
                    todo.append(below)
        return out

    def _state(self, nodes: dict[int, int]) -> int:
        key = frozenset(nodes.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(nodes)
            self.next.append({})
            met = [(e, self.term[v]) for v, e in nodes.items() if self.term[v] and e <= self.edits[self.term[v], False]]
            self.ends.append(min(met)[::-1] if met else None)
            begun = [(e, -len(self.stem[v]), self.stem[v]) for v, e in nodes.items() if self.stem[v] and e <= self.edits[self.stem[v], True]]
            self.starts.append((min(begun)[0], min(begun)[2]) if begun else None)
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        out: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if e <= self.allowed[node] and e < out.get(node, 9):
                out[node] = e

        for node, e in self.sets[state].items():
            put(node, e + 1)  # c is one letter too many
            for letter, below in self.child[node].items():
                if letter == c:
                    if e < out.get(below, 9):
                        out[below] = e
                else:
                    put(below, e + 1)
        to = self.next[state][c] = self._state(self._skipped(out))
        return to

    def meet(self, word: str) -> tuple[str, int, bool] | None:
        """(term, edits, as stem) of the nearest term that a word meets: whole words before stems, equally near ones by name."""
        if not self.may_meet(word):
            return None
        if len(self.sets) > MOST_STATES:
            self.reset()
        state, stem = self.first, None
        for k, c in enumerate(word):
            to = self.next[state].get(c)
            state = self._step(state, c) if to is None else to
            begun = self.starts[state]
            if begun and k + 1 < len(word) and (stem is None or begun[0] <= stem[0]):
                stem = begun
            if not self.sets[state]:
                break
        else:
            whole = self.ends[state]
            if whole is not None and (stem is None or whole[1] <= stem[0]) and not (whole[1] and word in self.own):
                return (*whole, False)
        return (stem[1], stem[0], True) if stem and not (stem[0] and word in self.own) else None


FEATURES = ("exact", "fuzzy", "stems", "quoted", "addressed", "density", "terms", "weight")
#: On which side of 0 weights stay: quotation excuses, all else accuses; the constant is free.
SIGNS = np.array([1.0, 1.0, 1.0, -1.0, 1.0, 1.0, 1.0, 1.0, 0.0])
#: The least scale of a feature: one that the sample hardly shows is not blown up.
LEAST_SCALE = 0.2


class Reader:
    """Counts of meetings in a text, by kind and context."""

    def __init__(self, lexicon: FuzzyLexicon):
        self.lexicon = lexicon
        self.seen: set[str] = set()
        self.met: dict[str, tuple[str, int, bool]] = {}  # of the words seen, those that meet a term

    def learn(self, words: set[str]) -> None:
        """Look up words that were not seen yet."""
        if len(self.seen) > REMEMBERED:
            self.seen.clear(), self.met.clear()
        for w in words:
            m = self.lexicon.meet(w)
            if m is not None:
                self.met[w] = m
        self.seen |= words

    def features(self, text: str | None) -> list[float]:
        lower = (text or "").lower()
        words = WORD.findall(lower)
        distinct = set(words)
        if not distinct <= self.seen:
            self.learn(distinct - self.seen if len(self.seen) <= REMEMBERED else distinct)
        hits = self.met.keys() & distinct
        if not hits:
            return [0.0] * len(FEATURES)
        exact = fuzzy = stems = quoted = addressed = 0
        weight, terms = 0.0, set()
        for k, found in enumerate(WORD.finditer(lower)):
            w = words[k]
            if w not in hits:
                continue
            m, (a, b) = self.met[w], found.span()
            near = set(words[max(0, k - WINDOW) : k + WINDOW + 1])
            before = lower[a - 1 : a] if a else ""
            told = before in QUOTES and before != "" and lower[b : b + 1] in QUOTES and b < len(lower) or not near.isdisjoint(REPORT)
            to_someone = not near.isdisjoint(ADDRESS)
            if told and not to_someone:
                quoted += 1
                continue
            addressed += to_someone
            terms.add(m[0])
            weight += self.lexicon.weight[m[0]] / (1 + m[1])
            if m[1]:
                fuzzy += 1
            elif m[2]:
                stems += 1
            else:
                exact += 1
        met, each = exact + stems + DISCOUNT * fuzzy, 100 / max(20, len(words))  # terms and their weight are told for a hundred words: long texts meet some by chance
        return [np.log1p(exact + DISCOUNT * fuzzy), np.log1p(fuzzy), np.log1p(stems), np.log1p(quoted), np.log1p(addressed), min(1.0, met * 20 / len(words)), np.log1p(len(terms) * each), np.log1p(weight * each)]

    def near(self, text: str | None) -> set[tuple[str, str, bool, int]]:
        """(word, term, as stem, edits) of the misspelled meetings of a text."""
        self.features(text)
        words = set(WORD.findall((text or "").lower()))
        return {(w, m[0], m[2], m[1]) for w, m in ((w, self.met[w]) for w in self.met.keys() & words) if m[1]}

    def misspelled(self, text: str | None) -> str | None:
        """The text with a letter of every term replaced that may be misspelled; None where there is no such term."""
        self.features(text)
        changed = False

        def put(found: re.Match) -> str:
            nonlocal changed
            w = found[0]
            m = self.met.get(w.lower())
            if m is None or m[1] or not self.lexicon.edits[m[0], m[2]]:
                return w
            changed = True
            at = 1 + zlib.crc32(w.encode()) % max(1, min(len(w), len(m[0])) - 2)  # not the first letter, and within a stem
            return w[:at] + ("0" if w[at] != "0" else "1") + w[at + 1 :]

        out = WORD.sub(put, text or "")
        return out if changed else None


def quotation(text: str | None, term: str) -> str:
    """A text in which somebody is told to have used a term."""
    words = (text or "").split(" ")
    return " ".join([*words[: len(words) // 2], f'"{term}",', *words[len(words) // 2 :]])


@lru_cache(maxsize=1)
def kept_reader(words: tuple[tuple[str, float], ...], stems: tuple[tuple[str, float], ...], edits: tuple[tuple[tuple[str, bool], int], ...], own: tuple[str, ...]) -> Reader:
    """A reader that a worker keeps: tasks with the same lexicon go on with its words and states."""
    return Reader(FuzzyLexicon(dict(words), dict(stems), dict(edits), own))


@dataclass
class Scorer:
    lexicon: FuzzyLexicon
    weights: np.ndarray | None  # of the scaled features, the last one constant
    scale: np.ndarray | None

    def score(self, rows: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.where(rows[:, 0] + rows[:, 1] >= np.log1p(2) - 1e-9, 0.9, 0.1)
        return 1 / (1 + np.exp(-np.clip(np.column_stack([rows / self.scale, np.ones(len(rows))]) @ self.weights, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.5, rounds: int = 40) -> np.ndarray:
    """Weights of a logistic regression by Newton steps, drawn to 0 but for the constant; weights that would be on the wrong side of 0 are 0."""
    free = np.ones(x.shape[1], bool)
    while True:
        w, pull = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
        pull[-1] = 1e-6
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (weight * (y - p)) - pull * w
            h = (x.T * (weight * (p * (1 - p) + 1e-9))) @ x + np.diag(pull)
            step = np.zeros(len(w))
            step[free] = np.linalg.solve(h[np.ix_(free, free)], g[free])
            w = w + step / max(1.0, np.abs(step).max() / 4)
        wrong = free & (w * SIGNS < 0)
        if not wrong.any():
            return w
        free[np.flatnonzero(wrong)[np.argmax(np.abs(w[wrong]))]] = False


def sample_of(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(text, toxic, row, a hash of the text) of at most most training rows of each class, stored."""
    known = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out())
    order = F.xxhash64("doc_id")
    some = known.filter("toxic = 1").orderBy(order, "doc_id").limit(most).union(known.filter("toxic = 0").orderBy(order, "doc_id").limit(most))
    ids = staged(some.withColumnRenamed("doc_id", "_id"), "sample_ids")  # 2 * most rows
    return staged(docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select("text", "toxic", F.xxhash64("text").alias("row")), "sample")


def learned_terms(sample: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems with the logarithm of their odds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = set(WORD.findall((text or "").lower()))
                sums[toxic].update(words)
                sums[toxic].update({f"{w[:n]}…" for w in words for n in STEMS if len(w) > n})
            if len(sums[0]) + len(sums[1]) > 300_000:
                yield told(sums)
                sums[0].clear(), sums[1].clear()
        yield told(sums)

    def told(sums: tuple[Counter, Counter]) -> pa.RecordBatch:
        terms = list(sums[0].keys() | sums[1].keys())
        return pa.record_batch([pa.array(terms, pa.string()), pa.array([sums[0][t] for t in terms], pa.int64()), pa.array([sums[1][t] for t in terms], pa.int64())], names=["term", "clean", "toxic"])

    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return {}, {}
    sums = sample.mapInArrow(count, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = ((F.col("toxic") + 0.1) / sizes[1]) / ((F.col("clean") + 0.1) / sizes[0])
    best = sums.filter(F.col("toxic") >= LEAST_TEXTS).withColumn("odds", odds).filter(F.col("odds") >= LEAST_ODDS).orderBy(F.desc("toxic"), "term").limit(MOST_TERMS).collect()
    wanted = frozenset(r["term"] for r in best)

    def uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for text in batch.column("text").to_pylist():
                words = WORD.findall((text or "").lower())
                for before, w, after in zip(["", *words], words, [*words[1:], ""], strict=False):
                    found.update((t, f"{before} {after}") for t in (w, *(f"{w[:n]}…" for n in STEMS if len(w) > n)) if t in wanted)
            yield pa.record_batch([pa.array([t for t, _ in found], pa.string()), pa.array([c for _, c in found], pa.string())], names=["term", "around"])

    # copies of a text repeat a word between the same two words: a term that few texts hold has to stand in as many places
    places = sample.filter("toxic = 1").select("text").mapInArrow(uses, "term string, around string").groupBy("term").agg(F.countDistinct("around").alias("n")).filter(F.col("n") >= LEAST_TEXTS)
    varied = {r["term"] for r in places.collect()}  # MOST_TERMS rows at most
    best = [r for r in best if r["term"] in varied or r["toxic"] >= LEAST_SHARE * sizes[1]]
    words = {r["term"]: float(np.log(r["odds"])) for r in best if not r["term"].endswith("…")}
    stems: dict[str, float] = {}
    for r in sorted((r for r in best if r["term"].endswith("…")), key=lambda r: len(r["term"])):
        stem = r["term"][:-1]
        whole = sum(1 for w in words if w.startswith(stem))
        # a stem is worth keeping if a shorter one is not kept already and it is not the beginning of a single word
        if r["toxic"] >= 2 * LEAST_TEXTS and whole != 1 and not any(stem.startswith(s) for s in stems):
            stems[stem] = float(np.log(r["odds"]))
    return words, stems


def certified(sample: DataFrame, words: dict[str, float], stems: dict[str, float]) -> tuple[FuzzyLexicon, list[set[str]]]:
    """The lexicon with the edits of every term that clean texts of the sample hardly meet, and the words near a term that either half of them holds."""
    edits = FuzzyLexicon(words, stems).edits
    clean = staged(sample.filter("toxic = 0").select("text", "row"), "clean")
    n = max(1, clean.count())
    for _ in range(ROUNDS):
        now = tuple(edits.items())

        def read(batches: Iterator[pa.RecordBatch], now: tuple = now) -> Iterator[pa.RecordBatch]:
            reader = Reader(FuzzyLexicon(words, stems, dict(now)))
            for batch in batches:
                found = [(row, *m) for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True) for m in reader.near(text)]
                columns = list(zip(*found, strict=True)) or [(), (), (), (), ()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int32()), strict=True)], names=["row", "word", "term", "stem", "e"])

        # of the sample, whose size is bounded: the words of its clean texts that lie near a term
        found = clean.mapInArrow(read, "row long, word string, term string, stem boolean, e int").collect()
        halves = [{r["word"] for r in found if r["row"] % 2 == half} for half in (0, 1)]
        met: dict[tuple[str, bool, int], set[int]] = defaultdict(set)
        for r in found:
            if r["word"] not in halves[1 - r["row"] % 2]:
                met[r["term"], r["stem"], r["e"]].add(r["row"])
        seen: set[int] = set()
        dropped: dict[tuple[str, bool], int] = {}
        for (term, stem, e), rows in sorted(met.items(), key=lambda x: (len(x[1]), -len(x[0][0]), x[0])):
            if len(seen | rows) > FALSE_SHARE * n:
                dropped[term, stem] = min(e, dropped.get((term, stem), 9))
            else:
                seen |= rows
        if not dropped:
            break
        edits = {key: min(e, dropped.get(key, 9) - 1) for key, e in edits.items()}  # a word that meets a term no more may meet another: looked at again
    return FuzzyLexicon(words, stems, edits, halves[0] | halves[1]), halves


def fitted(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Scorer:
    """A scorer learned from labelled training rows."""
    sample = sample_of(docs, labels, most)
    words, stems = learned_terms(sample)
    words = {t: 3.0 for t in INSULTS} | words
    lexicon, halves = certified(sample, words, stems)
    # a clean text is read as one that is not in the sample: the words that it holds itself excuse nothing
    others = [FuzzyLexicon(words, stems, lexicon.edits, halves[1 - half]) for half in (0, 1)]
    terms = sorted(words)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, parts = Reader(lexicon), [Reader(x) for x in others]
        for batch in batches:
            rows, kinds = [], []
            for text, toxic, row in zip(*[batch.column(c).to_pylist() for c in ("text", "toxic", "row")], strict=True):
                reader = whole if toxic else parts[row % 2]
                rows.append(reader.features(text))
                kinds.append((toxic, False))
                made = reader.misspelled(text) if toxic else quotation(text, terms[zlib.crc32((text or "").encode()) % len(terms)])
                if made is not None:
                    rows.append(reader.features(made))
                    kinds.append((toxic, True))
            yield pa.record_batch([pa.array(rows, pa.list_(pa.float64())), pa.array([k for k, _ in kinds], pa.int32()), pa.array([m for _, m in kinds])], names=["x", "toxic", "made"])

    rows = sample.mapInArrow(read, "x array<double>, toxic int, made boolean").collect()  # 4 * most rows of counts
    y = np.array([r["toxic"] for r in rows], float)
    if len(set(y)) < 2:
        return Scorer(lexicon, None, None)
    shares = {r["toxic"]: r["count"] for r in labels.filter("toxic in (0, 1)").filter(~held_out()).groupBy("toxic").count().collect()}
    x, made = np.array([r["x"] for r in rows]), np.array([r["made"] for r in rows])
    scale = np.maximum(x.std(0), LEAST_SCALE)
    # each class has the weight of its labels, and made texts half of what theirs have
    each = np.where(made, 0.5, 1.0)
    share = each * np.where(y == 1, shares[1] / each[y == 1].sum(), shares[0] / each[y == 0].sum())
    w = logistic(np.column_stack([x / scale, np.ones(len(x))]), y, share / share.mean())
    return Scorer(lexicon, w, scale)


def toxicity(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs."""
    bound_batches(docs.sparkSession)
    weight = scorer.lexicon.weight
    sent = docs.sparkSession.sparkContext.broadcast((*[tuple((t, weight[t]) for t in terms if t) for terms in (scorer.lexicon.term, scorer.lexicon.stem)], tuple(scorer.lexicon.edits.items()), tuple(sorted(scorer.lexicon.own)), scorer.weights, scorer.scale))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, stems, edits, own, weights, scale = sent.value
        reader = kept_reader(words, stems, edits, own)
        scorer = Scorer(reader.lexicon, weights, scale)
        for batch in batches:
            rows = np.array([reader.features(t) for t in batch.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            score = scorer.score(rows)
            yield pa.record_batch([batch.column("doc_id"), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(read, f"doc_id {kind}, score double, predicted int").select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, fitted(docs, table(spark, sf_dir, "labels")))
