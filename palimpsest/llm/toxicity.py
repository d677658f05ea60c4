"""Toxicity scores from a lexicon that tolerates misspellings.

Terms are learned from labelled rows: stems whose documents are toxic so much
more often than by chance that it can't be one. Strong terms are all but absent
from clean texts; weak stems also occur there, though rarely, and are counted
apart. A trie of the strong terms is intersected with Levenshtein automata; the
product is built state by state as tokens walk it. A term is met exactly as the
beginning of a word, or, if it is strong, within its edit distance as a whole
word. A window of words around each hit separates
quotation (quotation marks on both sides, or a reporting word before) from
abuse. A logistic regression over the hits gives the score.

Bounds: terms and weights are fitted on at most ``sample`` labelled rows of each
class (the smallest hashes of doc_id); what leaves the executors for that are
counts of the stems that can be terms, near spellings, and five numbers a row. All texts are
scored whole.

Edge cases: a null or empty text has the score of a text without hits; without
toxic labels there is no lexicon and all scores are 0; labels that are null,
or given twice and differ, count as toxic if any of them is; rows without a
doc_id are scored but not learned from; other columns are ignored.
"""

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_EDGE = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~«»“”„‘’¡¿…–—"
_QUOTES = "\"'«»“”„‘’"
#: words that announce that another's words follow
REPORTING = frozenset("said says say wrote writes called calls quote quoted quotes quoting shouted yelled".split())


@dataclass(frozen=True)
class ToxicityParams:
    sample: int = 6000
    min_docs: int = 4
    chance: float = 1e-4
    #: a term's rate in clean texts, as a share of its rate in toxic ones
    strong: float = 0.005
    weak: float = 0.16
    window: int = 6
    quoted_weight: float = 0.2
    stem_lengths: tuple[int, ...] = (3, 4, 5, 6, 7, 8, 9, 10, 11, 12)


def distance_for(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 10 else 2


class LexiconAutomaton:
    """The trie of ``terms`` intersected with their Levenshtein automata.

    A state is the set of (trie node, errors) that a token's beginning can have
    reached. The first letter has to agree. ``match`` gives 0 for a term that
    begins the token, 1 or 2 for a token within that distance of a term, else -1.
    """

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.budget = [0]  # the most errors that a term below the node allows
        self.allowed = [-1]  # of the term that ends here
        for term in terms:
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.budget.append(0)
                    self.allowed.append(-1)
                node = self.children[node][c]
                self.budget[node] = max(self.budget[node], distance_for(term))
            self.allowed[node] = distance_for(term)
        self.start = self._state({(0, 0)})
        self.steps: dict[frozenset, dict[str, frozenset]] = {}
        self.ends: dict[frozenset, tuple[bool, int]] = {}

    def _state(self, items: set[tuple[int, int]]) -> frozenset:
        """With what can be reached by leaving out letters of a term."""
        todo = list(items)
        while todo:
            node, errors = todo.pop()
            if node:
                for child in self.children[node].values():
                    if errors < self.budget[child] and (child, errors + 1) not in items:
                        items.add((child, errors + 1))
                        todo.append((child, errors + 1))
        return frozenset(items)

    def _step(self, state: frozenset, c: str) -> frozenset:
        out = set()
        for node, errors in state:
            child = self.children[node].get(c)
            if child is not None:
                out.add((child, errors))
            if node and errors < self.budget[node]:
                out.add((node, errors + 1))
                out.update((x, errors + 1) for x in self.children[node].values() if errors < self.budget[x])
        return self._state(out)

    def _end(self, state: frozenset) -> tuple[bool, int]:
        """Whether a term has been met exactly, and the fewest errors of a term that ends here."""
        errors = [e for n, e in state if 0 <= e <= self.allowed[n]]
        return 0 in errors, min(errors, default=-1)

    def match(self, token: str) -> int:
        state = self.start
        for c in token:
            known = self.steps.setdefault(state, {})
            after = known.get(c)
            if after is None:
                after = known[c] = self._step(state, c)
            if not after:
                return -1
            state = after
            if state not in self.ends:
                self.ends[state] = self._end(state)
            if self.ends[state][0]:
                return 0
        return self.ends[state][1] if token else -1


@dataclass
class ToxicityModel:
    terms: list[str]
    vetoed: frozenset[str] = frozenset()  # near spellings that clean texts use
    weak: frozenset[str] = frozenset()
    weights: np.ndarray = field(default_factory=lambda: np.array([-30.0, 0, 0, 0, 0, 0]))
    window: int = 6
    quoted_weight: float = 0.2

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def lookup(self, token: str) -> tuple[int, str]:
        """0 exact, 1 near, 2 weak, -1 none; the word without its edges."""
        word = token.strip(_EDGE)
        found = self._automaton.match(word)
        if found and any(word[:k] in self.weak for k in self._weak_lengths if k <= len(word)):
            return 2, word
        if found > 0 and word in self.vetoed:
            found = -1
        return min(found, 1), word

    def hits(self, text: str | None) -> list[tuple[int, int, str, bool]]:
        """(position in words, kind, word, quoted) of each hit."""
        if not text or not (self.terms or self.weak):
            return []
        if not hasattr(self, "_automaton"):
            self._automaton, self._known = LexiconAutomaton(self.terms), {}
            self._weak_lengths = sorted({len(t) for t in self.weak})
        if len(self._known) > 400_000:
            self._known = {}
        tokens = text.lower().split()
        known, found = self._known, set()
        for token in set(tokens):
            kind = known.get(token)
            if kind is None:
                kind = known[token] = self.lookup(token)[0]
            if kind >= 0:
                found.add(token)
        if not found:
            return []
        return [(i, known[t], t.strip(_EDGE), self._quoted(tokens, i)) for i, t in enumerate(tokens) if t in found]

    def _quoted(self, tokens: list[str], at: int) -> bool:
        before, after = tokens[max(0, at - self.window) : at], tokens[at + 1 : at + 1 + self.window]
        own = tokens[at]
        opened = own[0] in _QUOTES or any(t[0] in _QUOTES for t in before)
        closed = own.rstrip(".,;:!?")[-1:] in _QUOTES or any(t.rstrip(".,;:!?")[-1:] in _QUOTES for t in after)
        return opened and closed or any(t.strip(_EDGE) in REPORTING for t in before[-3:]) and (opened or closed)

    def features(self, found: list[tuple[int, int, str, bool]]) -> list[float]:
        """Logarithms of the hits, the near hits, the most in ten words and the weak hits; the share of quoted ones."""
        if not found:
            return [0.0] * 5
        weight = [self.quoted_weight if q else 1.0 for _, _, _, q in found]
        by_kind = [sum(w for w, h in zip(weight, found) if h[1] == kind) for kind in range(3)]
        most, k, sum_in = 0.0, 0, 0.0
        worth = [w * (1.0, 0.5, 0.5)[h[1]] for w, h in zip(weight, found)]
        for i, h in enumerate(found):
            sum_in += worth[i]
            while found[k][0] < h[0] - 9:
                sum_in -= worth[k]
                k += 1
            most = max(most, sum_in)
        return [*(math.log1p(x) for x in (*by_kind, most)), sum(w < 1 for w in weight) / len(found)]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(x @ self.weights[1:] + self.weights[0], -30, 30)
        return 1 / (1 + np.exp(-z))


def held_out(doc_id="doc_id"):
    """The rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def choose_terms(counts: list[tuple[str, int, int]], pos: int, neg: int, p: ToxicityParams) -> tuple[list[str], list[str]]:
    """Strong and weak stems, each as long as nearly all of its toxic documents allow."""
    base = pos / max(pos + neg, 1)
    have = {t: (a, b) for t, a, b in counts}

    def telling(a: int, b: int, most: float) -> bool:
        if a < p.min_docs or b * pos > most * a * neg:
            return False
        q = a / (a + b)
        gain = q * math.log(q / base) + ((1 - q) * math.log((1 - q) / (1 - base)) if b else 0.0)
        return -(a + b) * gain < math.log(p.chance)

    def grown(t: str) -> str:
        while longer := [x for x in below.get(t, ()) if have[x][0] >= 0.9 * have[t][0]]:
            t = longer[0]
        return t

    below: dict[str, list[str]] = {}
    for t in sorted(have):
        below.setdefault(t[:-1], []).append(t)
    order = sorted(have, key=lambda t: (len(t), t))
    strong: dict[str, str] = {}
    for t in order:
        if telling(*have[t], p.strong) and not any(t[:k] in strong for k in range(1, len(t))):
            strong[t] = grown(t)
    names, weak = sorted(strong), {}
    for t in order:
        if any(t[:k] in strong or t[:k] in weak for k in range(1, len(t) + 1)):
            continue
        a, b = have[t]
        if not telling(a, b, p.weak):
            continue
        own = [x for x in names[bisect_left(names, t) : bisect_left(names, t + "\U0010ffff")] if x in strong]
        # a strong stem below that explains most of it stays; many small ones are chance picks of a weak one
        if all(1.5 * have[x][0] < a for x in own):
            weak[t] = grown(t)
            for x in own:
                del strong[x]
    rank = lambda t: (-have[t][0], t)
    return sorted(set(strong.values()), key=rank), sorted(set(weak.values()), key=rank)


def _logistic(x: np.ndarray, y: np.ndarray, worth: np.ndarray) -> np.ndarray:
    """Newton steps with a small ridge, which keeps separable classes finite; a row counts ``worth`` times."""
    a = np.hstack((np.ones((len(x), 1)), x))
    w = np.zeros(a.shape[1])
    ridge = np.diag([1e-3] + [0.05] * x.shape[1])
    loss = lambda w: worth @ np.logaddexp(0, np.where(y > 0.5, -1, 1) * (a @ w)) + w @ ridge @ w / 2
    for _ in range(200):
        q = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (worth * q * (1 - q))[:, None]).T @ a + ridge, a.T @ (worth * (y - q)) - ridge @ w)
        now = loss(w)
        while loss(w + step) > now and np.abs(step).max() >= 1e-8:
            step = step / 2
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Learn terms and weights from labelled rows that aren't held out."""
    spark = docs.sparkSession
    own = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    labelled = {r.toxic: r["count"] for r in own.groupBy("toxic").count().collect()}
    picked = []
    for toxic in (0, 1):
        top = own.where(F.col("toxic") == toxic).select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.sample)
        picked += [(r.doc_id, r.toxic) for r in top.collect()]  # at most 2 * sample pairs of numbers
    if not any(t for _, t in picked) or all(t for _, t in picked):
        return ToxicityModel([])
    ids = spark.createDataFrame(picked, "doc_id long, toxic int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = (Counter(), Counter())
            for text, toxic in zip(batch.column("text"), batch.column("toxic"), strict=True):
                stems = set()
                for token in set((text.as_py() or "").lower().split()):
                    word = token.strip(_EDGE)
                    if word.isalpha():
                        stems.update(word[:k] for k in p.stem_lengths if k <= len(word))
                seen[toxic.as_py()].update(stems)
            names = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[1][x] for x in names], pa.int64()), pa.array([seen[0][x] for x in names], pa.int64())], names=["term", "pos", "neg"])

    counts = texts.mapInArrow(count, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    sizes = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    # a stem that stands in fewer toxic texts than ``min_docs``, or whose rate in clean ones is above ``weak``, can't be a
    # term; each letter that a term grows by may take a tenth of its toxic texts, so the limit leaves room for these
    most = p.weak / 0.9 ** len(p.stem_lengths)
    can_be = (F.col("pos") >= p.min_docs) & (F.col("neg") * float(pos) <= most * F.col("pos") * float(neg))
    rows = [(r.term, r.pos, r.neg) for r in counts.where(can_be).collect()]
    terms, weak = choose_terms(rows, pos, neg, p)
    model = ToxicityModel(terms, weak=frozenset(weak), window=p.window, quoted_weight=p.quoted_weight)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for text in batch.column("text"):
                near.append(sorted({w for _, kind, w, _ in model.hits(text.as_py()) if kind == 1}))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(near, pa.list_(pa.string()))], names=["doc_id", "toxic", "near"])

    # near spellings of one half of the clean texts are vetoed, weights come from the other half
    half = F.xxhash64("doc_id", F.lit(1)) % 2 == 0
    near = texts.where((F.col("toxic") == 0) & half).mapInArrow(measure, "doc_id long, toxic int, near array<string>")
    model.vetoed = frozenset(r.w for r in near.select(F.explode("near").alias("w")).distinct().collect())

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [model.features(model.hits(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "toxic", "x"])

    rows = texts.where((F.col("toxic") == 1) | ~half).mapInArrow(featured, "doc_id long, toxic int, x array<double>")
    means = F.array(*(F.avg(F.get("x", F.lit(k))) for k in range(5)))
    # a row for each picked id, 2 * sample at most, however often and with whatever texts documents hold it
    found = rows.groupBy("doc_id", "toxic").agg(means.alias("x"), F.count("*").alias("n")).collect()
    found.sort(key=lambda r: (r.doc_id, r.toxic))
    # each row stands for those of its class that the cap or the vetoes keep from the fit, so that neither moves the scores
    fitted, chosen = Counter(), Counter(t for _, t in picked)
    for r in found:
        fitted[r.toxic] += r.n
    worth = {t: labelled[t] / chosen[t] * sizes[t] / n for t, n in fitted.items()}
    model.weights = _logistic(np.array([r.x for r in found]), np.array([r.toxic for r in found], dtype=float), np.array([worth[r.toxic] * r.n for r in found]))
    return model


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, score, predicted, and the hits that the score rests on."""
    names = ["doc_id", "score", "n_exact", "n_near", "n_weak", "n_quoted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, exact, near, weak, quoted = [], [], [], [], []
            for text in batch.column(1):
                found = model.hits(text.as_py())
                x.append(model.features(found))
                exact.append(sum(h[1] == 0 for h in found))
                near.append(sum(h[1] == 1 for h in found))
                weak.append(sum(h[1] == 2 for h in found))
                quoted.append(sum(h[3] for h in found))
            s = model.score(np.array(x).reshape(-1, 5))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), *(pa.array(v, pa.int64()) for v in (exact, near, weak, quoted))], names=names)

    out = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, n_exact long, n_near long, n_weak long, n_quoted long")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_exact", "n_near", "n_weak", "n_quoted")
