"""Secret scans: patterns, and automata inferred from the credentials that the patterns label.

Values after an assignment, access keys and hex runs are labelled credentials. A bounded sample of them (``SAMPLE``
distinct values of least hash) is made into a prefix tree over character classes, and statistically compatible states
are merged in red-blue order with Hoeffding tests on their stopping and leaving frequencies, which gives a probabilistic
automaton of the credentials' formats. Every candidate of every text is scored: each run of at least ``LEAST``
characters that a labelled value may have, those inside base spans included (runs with a character that is in no labelled
value have no path and need no look). Its likelihood under the automaton is held
against that under a character-bigram model of ordinary words, counted over all rows outside the base spans. A candidate
outside the base spans is a span of kind ``format`` if it is as likely a credential, per character, as all but ``TAIL`` of the labelled values,
and its odds against an ordinary word are at least ``MARGIN`` bits: an ordinary word reaches these with a probability
below 2 ** -MARGIN.

Defined results: a null text is empty; an empty text has no spans; without labelled values there is no automaton, no
candidate is scored and there are only base spans; rows that repeat a doc_id each get a row; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import Scratch
from attesta.llm.spans import digest, ordered, over_texts

KINDS = ("assign", "access", "hex", "format")
#: Labelled values for the fit; confidence of the merge tests; share of labelled values below the cut; least characters
#: of a candidate, as of a labelled value; least odds in bits; weight of single characters' shares beside their bigrams;
#: candidates kept with their odds by a worker.
SAMPLE, ALPHA, TAIL, LEAST, MARGIN, BACKING, MEMO = 1000, 0.05, 0.02, 6, 20.0, 10.0, 400_000

_NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("(?<![0-9a-f])[0-9a-f]{24,}+")
_RUN = "A-Za-z0-9+/_=.-"
_CLASSES = (("0", "0123456789"), ("a", "abcdef"), ("g", "ghijklmnopqrstuvwxyz"), ("A", "ABCDEF"), ("G", "GHIJKLMNOPQRSTUVWXYZ"))
# The characters of candidates; place 0 is what stands before, between and behind words.
_LETTERS = "".join(letters for _, letters in _CLASSES) + "+/_=.-"
_PLACE = np.zeros(256, np.int64)
_PLACE[list(_LETTERS.encode())] = np.arange(1, len(_LETTERS) + 1)
_WIDTH = len(_LETTERS) + 1
_CLASS = {ord(c): name for name, letters in _CLASSES for c in letters}
_WITHIN = {name: math.log2(len(letters)) for name, letters in _CLASSES}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        found += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    return found + [(*m.span(), "hex") for m in _HEX.finditer(text)]


def labelled_values(text: str, base: list[tuple[int, int, str]]) -> list[str]:
    """The values of the base spans; of an assignment, what is assigned."""
    return [_ASSIGN.match(text, a, b)[1] if k == "assign" else text[a:b] for a, b, k in base]


class Grammar:
    """A probabilistic automaton by state merging. ``END`` is the symbol of stopping."""

    END = ""

    def __init__(self, values: list[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[Counter] = [Counter()]
        for value in values:
            at = 0
            for c in value.translate(_CLASS):
                self.count[at][c] += 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.count.append(Counter())
                at = self.next[at][c]
            self.count[at][self.END] += 1
        self._bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()

    def _differs(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return bool(n1 and n2) and abs(f1 / n1 - f2 / n2) > self._bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            n1, n2 = self.count[x].total(), self.count[y].total()
            if any(self._differs(self.count[x][c], n1, self.count[y][c], n2) for c in {*self.count[x], *self.count[y]}):
                return False
            todo += [(i, self.next[y][c]) for c, i in self.next[x].items() if c in self.next[y]]
        return True

    def _fold(self, red: int, blue: int) -> None:
        todo = [(red, blue)]
        while todo:
            x, y = todo.pop()
            self.count[x] += self.count[y]
            for c, i in self.next[y].items():
                if c in self.next[x]:
                    todo.append((self.next[x][c], i))
                else:
                    self.next[x][c] = i

    def _merge(self) -> None:
        red, seen = [0], {0}
        while True:
            blue = next(((r, c, i) for r in red for c, i in sorted(self.next[r].items()) if i not in seen), None)
            if blue is None:
                break
            r, c, i = blue
            same = next((x for x in red if self._compatible(x, i)), None)
            if same is None:
                red.append(i)
                seen.add(i)
            else:
                self.next[r][c] = same
                self._fold(same, i)
        number = {old: new for new, old in enumerate(red)}
        self.next = [{c: number[i] for c, i in self.next[old].items()} for old in red]
        self.count = [self.count[old] for old in red]

        self.steps = [{c: (i, math.log2(n[c] / n.total()) - _WITHIN.get(c, 0.0)) for c, i in after.items()} for after, n in zip(self.next, self.count, strict=True)]
        self.ends = [math.log2((n[self.END] + 0.5) / (n.total() + 1)) for n in self.count]

    def score(self, value: str) -> float:
        """log2 likelihood per character; -inf if the automaton has no path."""
        at, total, steps = 0, 0.0, self.steps
        for c in value.translate(_CLASS):
            step = steps[at].get(c)
            if step is None:
                return -math.inf
            at, bits = step
            total += bits
        return (total + self.ends[at]) / max(1, len(value))


def pairs_of(text: str, base: list[tuple[int, int, str]] = ()) -> np.ndarray:
    """How often each two characters of candidates stand in a row outside the base spans, a cell for each two places."""
    parts, at = [], 0
    for a, b, _ in sorted(base):
        parts.append(text[at:a])
        at = max(at, b)
    text = " ".join(["", *parts, text[at:], ""])
    place = _PLACE[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    found = np.bincount(place[:-1] * _WIDTH + place[1:], minlength=_WIDTH * _WIDTH)
    found[0] = 0
    return found


def learnt(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """(kind, key, n) of all rows in one pass: labelled values, and the character bigrams of all else.

    The bigrams are a table of under 5000 cells; values are counted per task before they are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, values = np.zeros(_WIDTH * _WIDTH, np.int64), Counter()

        def flush() -> pa.RecordBatch:
            cells = np.flatnonzero(pairs)
            keys, kinds, n = [*map(str, cells), *values], ["pair"] * len(cells) + ["value"] * len(values), [*pairs[cells].tolist(), *values.values()]
            pairs[:] = 0
            values.clear()
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(keys, pa.string()), pa.array(n, pa.int64())], ["kind", "key", "n"])

        for batch in batches:
            for cell in batch.column(0):
                text = cell.as_py() or ""
                base = base_spans(text)
                if base:
                    values.update(labelled_values(text, base))
                pairs += pairs_of(text, base)
                if len(values) > 100_000:
                    yield flush()
        yield flush()

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "kind string, key string, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))


class Scorer:
    def __init__(self, values: list[str], pairs: np.ndarray):
        """From labelled values and the numbers of character bigrams of ordinary text."""
        self.grammar = Grammar(values) if values else None
        table, names = pairs.reshape(_WIDTH, _WIDTH), " " + _LETTERS
        alone = table.sum(0) + 0.5  # what follows a rare character is guessed from all text
        bits = np.log2((table + BACKING * alone / alone.sum()) / (table.sum(1, keepdims=True) + BACKING))
        self.bits = {a + b: float(bits[i, j]) for i, a in enumerate(names) for j, b in enumerate(names)}
        scores = sorted(self.grammar.score(v) for v in values) if values else []
        self.least = scores[int(len(scores) * TAIL)] if scores else math.inf
        # Runs of characters that the automaton knows; any other has no path.
        known = {c for after in self.grammar.next for c in after} if values else set()
        spelt = "".join(map(re.escape, [*(x for c, letters in _CLASSES if c in known for x in letters), *(c for c in "+/_=-" if c in known)]))
        self.run = re.compile(f"(?<![{_RUN}])[{spelt}.]{{{LEAST},}}+(?![{_RUN}])")
        self.memo: dict[str, tuple[float, bool]] = {}

    def __reduce__(self):  # the worker's memory of candidates is not sent
        return _unpickled, ({k: v for k, v in self.__dict__.items() if k != "memo"},)

    def ordinary(self, value: str) -> float:
        """log2 likelihood of a value as an ordinary word."""
        bits, value = self.bits, f" {value} "
        return sum([bits[value[i : i + 2]] for i in range(len(value) - 1)])

    def odds(self, value: str) -> tuple[float, bool]:
        """Bits by which a candidate is likelier a credential than an ordinary word, and whether that makes it one.

        -inf if it is less likely, per character, than the labelled values are.
        """
        found = self.memo.get(value)
        if found is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            s = self.grammar.score(value) if len(value) >= LEAST else -math.inf
            bits = s * len(value) - self.ordinary(value) if s >= self.least else -math.inf
            found = self.memo[value] = (bits, bits >= MARGIN)
        return found

    def scan(self, text: str, base: list[tuple[int, int, str]]) -> tuple[list[tuple[int, int, str]], int, float]:
        """Spans that the automaton adds; how many candidates it can spell; the largest odds of any, in bits."""
        if self.grammar is None:
            return [], 0, -math.inf
        runs, memo = self.run.findall(text), self.memo
        scored = {run: memo.get(run) or self.odds(run.strip(".")) for run in set(runs)}
        most = max((bits for bits, _ in scored.values()), default=-math.inf)
        found = []
        if any(is_one for _, is_one in scored.values()):
            for m in self.run.finditer(text):
                if scored[m[0]][1]:
                    a, b = m.end() - len(m[0].lstrip(".")), m.start() + len(m[0].rstrip("."))
                    if not any(x < b and a < y for x, y, _ in base):
                        found.append((a, b, "format"))
        return found, len(runs), most


def _unpickled(state: dict) -> Scorer:
    out = Scorer.__new__(Scorer)
    out.__dict__.update(state, memo={})
    return out


def fit(docs: DataFrame, *, text_col: str = "text", sample: int = SAMPLE) -> Scorer:
    """A scorer from at most ``sample`` labelled values of least hash and the words of all rows."""
    found = Scratch(docs.sparkSession).keep(learnt(docs, text_col=text_col))
    values = found.where("kind = 'value'").select("key").orderBy(F.xxhash64("key"), "key").limit(sample).collect()
    pairs = np.zeros(_WIDTH * _WIDTH, np.int64)
    for r in found.where("kind = 'pair'").collect():
        pairs[int(r.key)] = r.n
    return Scorer(sorted(r.key for r in values), pairs)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, all spans as text, and of the automaton: spans, candidates, largest odds."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, text_col=text_col, sample=sample))  # bounded by the sample

    def make():
        scorer = shared.value

        def row(text: str) -> tuple:
            base = base_spans(text)
            n = Counter(k for _, _, k in base)
            extra, scored, most = scorer.scan(text, base)
            return *(n[k] for k in KINDS[:3]), digest(ordered(base, KINDS)), ordered(base + extra, KINDS), len(extra), scored, most if most > -math.inf else None

        return row

    fields = [(f"n_{k}", "bigint", pa.int64()) for k in KINDS[:3]] + [(c, "string", pa.string()) for c in ("base_sha256", "spans")]
    fields += [("n_format", "bigint", pa.int64()), ("n_scored", "bigint", pa.int64()), ("most_bits", "double", pa.float64())]
    return over_texts(docs, make, fields, id_col=id_col, text_col=text_col)
