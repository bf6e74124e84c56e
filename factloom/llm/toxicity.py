"""Toxicity: a learned lexicon, its misspellings by Levenshtein automata, and contexts.

The lexicon holds words and stems (beginnings of words) that labelled toxic documents
use far more often than others. Its trie is intersected with Levenshtein automata
(edits and swaps of neighbours; ALLOWED by a term's length): a state of the product is
the set of trie nodes within reach and their edits so far, made when a text first
needs it, and all words of a portion walk that table together, one letter a step, until they
die or end. Before the walk digits and signs that stand for letters become those
letters and letters repeated three times or more become one.

What is caught weighs by its term and its kind, and by what labelled documents say of
that very spelling, so that an innocent neighbour of a term weighs nothing. A window
of CONTEXT code points on each side separates abuse from quotation: within quotation
marks or after a word of reporting a term counts as quoted, unless someone is addressed.
A logistic curve over the abusive weight, its share of the text and the quoted weight
gives the score; its coefficients are fitted from PRIOR.

Copies prove nothing anew: a term counts for no more documents than different words
stand before it, so the odd words of a text with a thousand copies are no terms.

Lexicon, spellings and curve are learned from at most SAMPLE labelled documents that
are not held out, those whose ids hash lowest; every whole text is scored.

Edge cases: a null or empty text has no term and the score of the curve alone; labels
with a null id or label are passed over, an id with several labels is toxic if one
says so, and one with several texts gives its least one to the sample; a null id is not
held out and never learned from; repeated rows are scored one by one; a text of any
length is read whole, alone in its portion; without labels of both kinds the lexicon is
empty and all scores are that of PRIOR; an empty table gives no rows. Columns other
than id and text are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.tables import portions
from factloom.session import cut

#: Labelled documents that are learned from, at most.
SAMPLE = 20_000
#: The remainder of crc32(id) by 4 that is held out.
HELD_OUT = 2
THRESHOLD = 0.3
#: Terms and spellings at most, and candidates for terms whose clean documents are counted.
LEXICON, SPELLINGS, CANDIDATES = 100, 20_000, 50_000
#: A term has so many toxic documents and words before it, so large a log-likelihood
#: ratio, and is so many times commoner in toxic documents.
MIN_DOCS, MIN_G2, LIFT = 6, 25.0, 8.0
STEM = (3, 10)
#: Edits by a term's letters: none under 5, one under 9, else two; stems are met exactly.
ALLOWED = (5, 9)
#: What a misspelled, a disguised and a stem's word weigh beside the term itself.
MISSPELLED, DISGUISED, STEMMED = 0.6, 0.9, 0.8
#: Documents that the weight of a spelling's kind counts for beside its own documents.
SHRINK = 3
CONTEXT = 48
QUOTED, ADDRESSED = 0.3, 1.3
#: Bias and slopes of: log abusive weight, log abusive weight a hundred words, log quoted weight.
PRIOR, RIDGE = np.array([-4.0, 1.0, 1.0, 0.3]), 1.0
STATES = 50_000
#: Bits of the bitmap that tells how many different words stand before a term.
BITS, FEW_EMPTY = 63, 8

_LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_MARKS = (('"', '"'), ("“", "”"), ("„", "“"), ("«", "»"), ("»", "«"), ("‘", "’"), ("`", "`"))
_REPORTING = frozenset("word words term terms called quote quoted quoting said says wrote insult slur meaning definition mot terme dit disait insulte wort begriff sagte nannte palabra dijo llamado insulto".split())
_ADDRESS = frozenset("you your yours yourself u ur du dich dein deine toi vous ton tú eres usted".split())
_WORD = re.compile(r"[^\W_]+")


# -- the lexicon's automaton ------------------------------------------------------


@dataclass
class Term:
    text: str
    stem: bool
    weight: float

    @property
    def allowed(self) -> int:
        return 0 if self.stem else sum(len(self.text) >= n for n in ALLOWED)


@dataclass
class Automaton:
    """The trie of terms times their Levenshtein automata, determinised as needed.

    Letters are numbered by first use in the terms (0: any other). A state is the
    edits spent at each trie node, the half-read swaps, and the stem met, if any."""

    terms: list[Term]
    children: list[dict[int, int]] = field(default_factory=lambda: [{}])
    ends: list[list[int]] = field(default_factory=lambda: [[]])
    reach: list[int] = field(default_factory=lambda: [0])

    def __post_init__(self):
        self.letters: dict[str, int] = {}
        for n, term in enumerate(self.terms):
            at = 0
            self.reach[0] = max(self.reach[0], term.allowed)
            for ch in term.text:
                c = self.letters.setdefault(ch, len(self.letters) + 1)
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.reach.append(0)
                at = self.children[at][c]
                self.reach[at] = max(self.reach[at], term.allowed)
            self.ends[at].append(n)
        self.of = np.zeros(0x110000, np.uint16)
        for ch, c in self.letters.items():
            self.of[ord(ch)] = c
        self.forget()

    def forget(self):
        """Back to the dead state (0) and the first one (1)."""
        self.known: dict = {}
        self.states: list = []
        self.next = np.full((64, len(self.letters) + 1), -1, np.int32)
        self.term, self.edits = np.full(64, -1, np.int32), np.zeros(64, np.int32)
        self.settled = np.zeros(64, bool)
        self._state({}, frozenset(), -1)
        self._state(self._spent({0: 0}), frozenset(), -1)

    def _spent(self, at: dict[int, int]) -> dict[int, int]:
        """Also the nodes that a left-out letter leads to."""
        todo = list(at.items())
        while todo:
            node, e = todo.pop()
            for child in self.children[node].values():
                if e + 1 <= self.reach[child] and e + 1 < at.get(child, 99):
                    at[child] = e + 1
                    todo.append((child, e + 1))
        return at

    def _state(self, at: dict[int, int], swaps: frozenset, stem: int) -> int:
        key = (tuple(sorted(at.items())), swaps, stem)
        if key in self.known:
            return self.known[key]
        n = self.known[key] = len(self.states)
        self.states.append((at, swaps, stem))
        if n == len(self.term):
            self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
            self.term, self.edits = np.concatenate([self.term, np.full_like(self.term, -1)]), np.concatenate([self.edits, np.zeros_like(self.edits)])
            self.settled = np.concatenate([self.settled, np.zeros_like(self.settled)])
        found = [(self.terms[t].weight * MISSPELLED**e, -t, e) for node, e in at.items() for t in self.ends[node] if e <= self.terms[t].allowed]
        if stem >= 0:
            found.append((self.terms[stem].weight * STEMMED, -stem, 0))
        if found:
            _, t, e = max(found)
            self.term[n], self.edits[n] = -t, e
        self.settled[n] = not at and not swaps  # dead, or nothing but a stem that was met
        if self.settled[n]:
            self.next[n] = n
        return n

    def _step(self, state: int, c: int) -> int:
        at, swaps, stem = self.states[state]
        new, half = {}, set()

        def put(node: int, e: int):
            if e <= self.reach[node] and e < new.get(node, 99):
                new[node] = e

        for node, e in at.items():
            put(node, e + 1)  # one letter too many
            for x, child in self.children[node].items():
                put(child, e + (x != c))
                if x != c and c in self.children[child]:  # c came before x
                    to = self.children[child][c]
                    if e + 1 <= self.reach[to]:
                        half.add((to, x, e + 1))
        for to, x, e in swaps:
            if x == c:
                put(to, e)
        for node, e in new.items():
            for t in self.ends[node]:
                if self.terms[t].stem and e == 0 and (stem < 0 or self.terms[t].weight > self.terms[stem].weight):
                    stem = t
        return self._state(self._spent(new), frozenset(half), stem)

    def match(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(term or -1, edits) of each word, given as its first letter's place and its length."""
        if len(self.states) > STATES:
            self.forget()
        letter = self.of[codes]
        state = np.ones(len(start), np.int32)
        live, k = np.flatnonzero(size > 0), 0
        while len(live):
            now, c = state[live], letter[start[live] + k]
            to = self.next[now, c]
            new = to < 0
            if new.any():
                for s, x in np.unique(np.stack([now[new], c[new].astype(np.int32)], 1), axis=0).tolist():
                    n = self._step(s, x)  # may make the table anew
                    self.next[s, x] = n
                to = self.next[now, c]
            state[live] = to
            k += 1
            live = live[~self.settled[to] & (size[live] > k)]
        return self.term[state], self.edits[state]


_automata: dict[tuple, Automaton] = {}


def automaton(terms: list[Term]) -> Automaton:
    """The automaton of these terms; a worker keeps the last one between its tasks."""
    key = tuple((t.text, t.stem, t.weight) for t in terms)
    if key not in _automata:
        _automata.clear()
        _automata[key] = Automaton(terms)
    return _automata[key]


# -- words and their contexts ------------------------------------------------------

_tables: list = []


def _code_tables() -> tuple[np.ndarray, np.ndarray]:
    """(which code points are letters or digits, what each stands for)."""
    if not _tables:
        alnum = np.zeros(0x110000, bool)
        alnum[:0x32000] = [chr(c).isalnum() for c in range(0x32000)]
        stands = np.arange(0x110000, dtype=np.uint32)
        for a, b in _LEET.items():
            stands[ord(a)] = ord(b)
        _tables.append((alnum, stands))
    return _tables[0]


@dataclass
class Words:
    """All words of some lowered texts: their letters in `codes`, undisguised."""

    codes: np.ndarray
    start: np.ndarray
    size: np.ndarray
    #: Where a word stands in its text (first and last code point + 1), its text, and whether it was disguised.
    first: np.ndarray
    last: np.ndarray
    doc: np.ndarray
    disguised: np.ndarray


def words_of(texts: list[str]) -> Words:
    alnum, stands = _code_tables()
    code = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    inside = alnum[code]
    sign = np.isin(code, np.array([ord(c) for c in "@$!*"], np.uint32))
    sign[1:-1] &= inside[:-2] & inside[2:]
    sign[:1] = sign[-1:] = False
    inside |= sign  # a sign between two letters belongs to the word
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    over = ~inside
    over[1:] &= inside[:-1]
    over[:1] = False
    same = np.zeros(len(code) + 1, bool)
    same[1:-1] = code[1:] == code[:-1]
    repeated = same[:-1] & (np.concatenate([[False], same[:-2]]) | same[1:])
    kept = np.flatnonzero(inside & ~repeated)
    start = np.flatnonzero(begins[kept])
    codes = stands[code[kept]]
    size = np.diff(np.append(start, len(kept)))
    first, last = np.flatnonzero(begins), np.flatnonzero(over)
    changed = np.concatenate([[0], np.cumsum(codes != code[kept])])
    disguised = (changed[start + size] != changed[start]) | (last - first != size)
    doc = np.searchsorted(ends, first, "right")
    began = ends[doc] - np.array([len(t) + 1 for t in texts])[doc] if len(doc) else first
    return Words(codes, start, size, first - began, last - began, doc, disguised)


def context(text: str, first: int, last: int) -> tuple[bool, float]:
    """(whether the term at first:last is quoted, how much it counts)."""
    left, right = text[max(0, first - CONTEXT) : first], text[last : last + CONTEXT]
    left, right = left.rpartition("\n")[2], right.partition("\n")[0]
    quoted = False
    for a, b in _MARKS:
        at = left.rfind(a)
        if at >= 0 and b in right and (left.count(a) % 2 if a == b else b not in left[at + 1 :]):
            quoted = True
    before, after = _WORD.findall(left), _WORD.findall(right)
    addressed = not _ADDRESS.isdisjoint(before) or not _ADDRESS.isdisjoint(after)
    reported = not _REPORTING.isdisjoint(before)
    if (quoted or reported) and not addressed:
        return True, QUOTED if not (quoted and reported) else QUOTED / 2
    return False, ADDRESSED if addressed else 1.0


@dataclass
class Model:
    terms: list[Term] = field(default_factory=list)
    spellings: dict[str, float] = field(default_factory=dict)
    curve: np.ndarray = field(default_factory=lambda: PRIOR.copy())


def _kind_weight(term: Term, edits: int, disguised: bool) -> float:
    return term.weight * MISSPELLED**edits * (DISGUISED if disguised else 1.0) * (STEMMED if term.stem else 1.0)


def found(texts: list[str], terms: list[Term]) -> Iterator[tuple]:
    """(text's number, spelling, its weight by kind, first, last) of each term met in
    lowered texts; also None as the last, and the number of words of each text."""
    w = words_of(texts)
    if terms and len(w.start):
        term, edits = automaton(terms).match(w.codes, w.start, w.size)
        for i in np.flatnonzero(term >= 0).tolist():
            s = int(w.start[i])
            spelling = "".join(map(chr, w.codes[s : s + min(int(w.size[i]), 40)]))
            yield int(w.doc[i]), spelling, _kind_weight(terms[term[i]], int(edits[i]), bool(w.disguised[i])), int(w.first[i]), int(w.last[i])
    yield None, np.bincount(w.doc, minlength=len(texts))


def features(texts: list[str], model: Model) -> np.ndarray:
    """The curve's inputs of each text: 1, and the three logarithms."""
    lowered = [t.lower() for t in texts]
    told: dict[tuple, list] = {}
    for doc, *rest in found(lowered, model.terms):
        if doc is None:
            n_words = rest[0]
            break
        spelling, weight, first, last = rest
        weight = model.spellings.get(spelling, weight)
        if weight > 0:
            quoted, counts = context(lowered[doc], first, last)
            t = told.setdefault((doc, spelling, quoted), [0, 0.0])
            t[0] += 1
            t[1] = max(t[1], weight * counts)
    abuse, quote = np.zeros(len(texts)), np.zeros(len(texts))
    for (doc, _, quoted), (n, weight) in told.items():
        (quote if quoted else abuse)[doc] += weight * (1 + math.log(n))
    return np.stack([np.ones(len(texts)), np.log1p(abuse), np.log1p(100 * abuse / (n_words + 20)), np.log1p(quote)], 1)


# -- learning ----------------------------------------------------------------------


def candidates(text: str, known: frozenset | None = None) -> dict[str, int]:
    """The words of a text and, with a star, the beginnings of its words (of those known
    alone, if told), each with a bitmap of the words that stand before it."""
    out: dict[str, int] = {}
    names: dict[str, list[str]] = {}
    before = ""
    for w in _WORD.findall(text.lower()):
        if w not in names:
            all_ = [w] * (len(w) <= 40) + [w[:n] + "*" for n in range(STEM[0], min(STEM[1], len(w) - 1) + 1)]
            names[w] = all_ if known is None else [x for x in all_ if x in known]
        if names[w]:
            bit = 1 << zlib.crc32(before.encode()) % BITS
            for name in names[w]:
                out[name] = out.get(name, 0) | bit
        before = w
    return out


def apart(docs: int, bits: int) -> float:
    """How many documents a term has that do not copy each other: no more than there are
    different words before it, by linear counting (a bitmap nearly full tells no more than
    that they are many)."""
    empty = BITS - bits.bit_count()
    return float(docs) if empty < FEW_EMPTY else min(float(docs), -BITS * math.log(empty / BITS))


def log_odds(t, c, n_toxic: int, n_clean: int):
    return np.log((t + 0.5) / (n_toxic + 1)) - np.log((c + 0.5) / (n_clean + 1))


def g2(t, c, n_toxic: int, n_clean: int):
    """The log-likelihood ratio of a term's document counts against independence."""
    cells, n = ((t, n_toxic), (c, n_clean), (n_toxic - t, n_toxic), (n_clean - c, n_clean)), n_toxic + n_clean
    rows = (t + c, t + c, n - t - c, n - t - c)
    return 2 * sum(a * np.log(np.maximum(a, 1e-12) * n / np.maximum(r * k, 1e-12)) for (a, k), r in zip(cells, rows))


def choose(rows: list[tuple[str, float, float]], n_toxic: int, n_clean: int, most: int = LEXICON) -> list[Term]:
    """Terms from (candidate, toxic documents, clean documents): surest first, a whole
    word before a stem that is about as sure, and no stem of what was taken or the reverse."""
    if not rows or not n_toxic or not n_clean:
        return []
    t, c = (np.array([r[k] for r in rows], float) for k in (1, 2))
    sure, odds = g2(t, c, n_toxic, n_clean), log_odds(t, c, n_toxic, n_clean)
    order = sorted((i for i in range(len(rows)) if t[i] >= MIN_DOCS and sure[i] >= MIN_G2 and odds[i] >= math.log(LIFT)), key=lambda i: (-round(math.log(sure[i]), 1), rows[i][0].endswith("*"), -len(rows[i][0]), rows[i][0]))
    out: list[Term] = []
    for i in order:
        if len(out) == most:
            break
        word, stem = rows[i][0].rstrip("*"), rows[i][0].endswith("*")
        if not any((stem or o.stem) and (word.startswith(o.text) or o.text.startswith(word)) for o in out):
            out.append(Term(word, stem, float(odds[i])))
    return out


def spelling_weight(kind: float, t: int, c: int, n_toxic: int, n_clean: int) -> float:
    own = float(log_odds(t, c, n_toxic, n_clean))
    return max(0.0, ((t + c) * own + SHRINK * kind) / (t + c + SHRINK))


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The curve's coefficients: Newton steps on the log-likelihood with a ridge around PRIOR."""
    b = PRIOR.copy()
    if len(set(y.tolist())) < 2:
        return b
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(b)), x.T @ (y - p) - RIDGE * (b - PRIOR))
        b = b + step
        if np.abs(step).max() < 1e-9:
            break
    return b


def _learned_on(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """text, toxic of the sample, one row an id, in the shared folder."""
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    told = told.where(~_held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = F.broadcast(told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))  # sample rows of two numbers
    return cut(docs.join(some, "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"))


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == HELD_OUT, F.lit(False))


def _counted(rows: DataFrame, of, schema: str) -> DataFrame:
    """Document counts by `of(texts, toxic)`, a task's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 0):
                counts = of(part.column(0).to_pylist(), part.column(1).to_pylist())
                yield pa.RecordBatch.from_pylist([{"word": w, **c} for w, c in counts.items()], schema=pa.schema([("word", pa.string()), *[(n, pa.float64() if n == "kind" else pa.int64()) for n in schema.split()]]))

    return rows.mapInArrow(run, "word string, " + ", ".join(f"{n} {'double' if n == 'kind' else 'long'}" for n in schema.split()))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of the labelled documents of docs (doc_id, text)."""
    rows = _learned_on(docs, labels, sample)
    n = dict(rows.groupBy((F.col("toxic") == 1).alias("bad")).count().collect())
    n_toxic, n_clean = n.get(True, 0), n.get(False, 0)
    if not n_toxic or not n_clean:
        return Model()

    def told(known: frozenset | None):
        def of(texts, toxic):
            out: dict[str, dict] = {}
            for t in texts:
                for name, bits in candidates(t, known).items():
                    o = out.setdefault(name, {"docs": 0, "bits": 0})
                    o["docs"] += 1
                    o["bits"] |= bits
            return out

        return of

    def summed(part: DataFrame, known: frozenset | None) -> DataFrame:
        return _counted(part, told(known), "docs bits").groupBy("word").agg(F.sum("docs").alias("n"), F.bit_or("bits").alias("bits"))

    often = summed(rows.where("toxic = 1"), None).where((F.col("n") >= MIN_DOCS) & (F.bit_count("bits") >= MIN_DOCS - 1))
    often = {r["word"]: apart(r["n"], r["bits"]) for r in often.orderBy(F.desc("n"), "word").limit(CANDIDATES).collect()}
    clean = {r["word"]: apart(r["n"], r["bits"]) for r in summed(rows.where("toxic <> 1"), frozenset(often)).collect()}
    terms = choose([(w, t, clean.get(w, 0.0)) for w, t in often.items()], n_toxic, n_clean)

    def spelled(texts, toxic):
        met = {(doc, rest[0]): rest[1] for doc, *rest in found([t.lower() for t in texts], terms) if doc is not None}
        out: dict[str, dict] = {}
        for (doc, spelling), kind in met.items():
            o = out.setdefault(spelling, {"kind": kind, "t": 0, "c": 0})
            o["t" if toxic[doc] == 1 else "c"] += 1
            o["kind"] = max(o["kind"], kind)
        return out

    met = _counted(rows, spelled, "kind t c").groupBy("word").agg(F.max("kind").alias("kind"), F.sum("t").alias("t"), F.sum("c").alias("c"))
    spellings = {r["word"]: spelling_weight(r["kind"], r["t"], r["c"], n_toxic, n_clean) for r in met.orderBy(F.desc(F.col("t") + F.col("c")), "word").limit(SPELLINGS).collect()}
    model = Model(terms, spellings)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 0):
                x = features(part.column(0).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column(1), *(pa.array(x[:, k]) for k in range(1, 4))], names=["toxic", "a", "b", "c"])

    told = rows.mapInArrow(measured, "toxic int, a double, b double, c double").toPandas().sort_values(["toxic", "a", "b", "c"])  # at most `sample` rows of four numbers
    model.curve = fit(np.c_[np.ones(len(told)), told[["a", "b", "c"]].to_numpy()], (told["toxic"] == 1).to_numpy(float))
    return model


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold) per row of docs."""
    d = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    model = learn(d, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 2):
                x = features([t or "" for t in part.column(2).to_pylist()], model)
                score = np.round(1 / (1 + np.exp(-np.clip(x @ model.curve, -30, 30))), 9)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return d.select("doc_id", _held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
