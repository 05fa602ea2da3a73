"""Secret scans: fixed patterns, and a guess-cost dynamic programme over values in a credential context.

The fixed patterns find assignments, access keys and hex strings. Every value that follows a credential word, those of
assignments included, is priced: the cheapest segmentation into common words, dates, repeats, keyboard walks and
sequences, and brute-force spans gives the guesses that it takes. Values of 10 ** LEAST guesses or more are secrets and
get a span of kind `guess` (of the value alone, so it may lie in an assignment's span); cheaper ones are placeholders,
weak passwords or prose. Fixed spans stay whatever their values cost.

Words are ranked by how often the corpus has them: learn_words() counts the words of all texts outside of such values,
and the most frequent DICTIONARY of them are the broadcast dictionary. So ordinary prose ("the token is invalid") is
cheap in any language, and a value is no word for being a secret itself.

Spans are in code points, end exclusive. Defined results: a null text is empty and has no span. A span's order is
by start, then kind. Repeated rows are scanned each for itself; an empty table gives an empty result; without a
dictionary the common passwords alone are words; other columns are not touched.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_arrow, materialize, rank_rows, texts

# The patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "guess"]

#: log10 of the guesses from which a value counts as a secret; words of the dictionary; words that a task counts at a time.
LEAST, DICTIONARY, HELD = 8.0, 100_000, 300_000
_CONTEXT = re.compile(r"""(?:password|passwd|passphrase|pwd|passcode|credential|client_secret|secret|private_key|access_key|auth_token|token|api[_-]?key|bearer)["']?\x20*(?:[:=]|\x20is\x20)\x20*(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"'<>,;]+))""", re.I | re.A)
_HINTS = ("passw", "passp", "passc", "pwd", "credential", "secret", "private_key", "access_key", "token", "api", "bearer")

# Common passwords and words in passwords, most frequent first.
WORDS = """password secret admin welcome login letmein monkey dragon master qwerty sunshine princess shadow football
baseball michael superman batman trustno hello freedom whatever charlie jordan hunter ranger buster soccer hockey
killer george andrew thomas robert daniel summer winter spring autumn ginger pepper cookie cheese orange banana silver
golden purple yellow green black white blue red love angel flower computer internet google server database default
changeme example sample test testing user root guest demo temp public private token api key pass code value here your
my the and for this that none null true false undefined placeholder dummy foo bar baz todo replace insert enter
january february march april may june july august september october november december monday tuesday wednesday
thursday friday saturday sunday system service account access office company home house family mother father""".split()
_COMMON = {w: k + 2 for k, w in reversed(list(enumerate(WORDS)))}
_WORD = re.compile(r"[^\W\d_]{3,24}")
_LEET = str.maketrans("4301578$@!", "aeoistbsai")
_ROWS = ["1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm"]
_NEAR = {(a, b) for row in _ROWS for a, b in zip(row, row[1:], strict=False)} | {(a, b) for up, low in zip(_ROWS, _ROWS[1:], strict=False) for a, b in zip(up, low, strict=False)}
_NEAR |= {(b, a) for a, b in _NEAR}
_DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/.]?(?:0?[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d")
_SEGMENT = math.log10(2)  # each further segment doubles the guesses: where it begins is not known


def _brute(c: str) -> float:
    return 1.0 if c.isdigit() else math.log10(26) if c.isascii() and c.isalpha() else math.log10(33)


class Ranks:
    """Ranks of words: common passwords, and the corpus's words from the most frequent on."""

    def __init__(self, words: list[str] | None = None) -> None:
        self.rank = {w: k + 2 for k, w in enumerate(words or [])}
        self.rank |= {w: min(k, self.rank.get(w, k)) for w, k in _COMMON.items()}
        self.longest = max(map(len, self.rank))


def segments(value: str, ranks: Ranks) -> list[tuple[int, int, float]]:
    """(start, end, log10 guesses) of the words, dates, repeats, walks and sequences in a value."""
    low, found, n = value.lower(), [], len(value)
    if len(low) != n:  # lower-casing some letters makes two of one
        low = "".join(x if len(x := c.lower()) == 1 else c for c in value)
    plain = low.translate(_LEET)
    for i in range(n):
        for j in range(i + 3, min(n, i + ranks.longest) + 1):
            for word, more in ((low[i:j], 0.0), (plain[i:j], math.log10(4))):
                if word in ranks.rank and (not more or word != low[i:j]):
                    case = 0.0 if value[i:j] == low[i:j] else math.log10(2) if value[i:j].istitle() or value[i:j].isupper() else (j - i) * math.log10(2)
                    found.append((i, j, math.log10(ranks.rank[word]) + more + case))
    found += [(m.start(), m.end(), 2.1 if m.end() - m.start() == 4 else 4.6) for i in range(n) if (m := _DATE.match(value, i))]
    for i in range(n):  # maximal runs of one kind of step
        for unit in (1, 2, 3, 4):
            if i and value[i - 1 : i] == value[i + unit - 1 : i + unit]:
                continue  # inside of a run that began before
            j = i + unit
            while j < n and value[j] == value[j - unit]:
                j += 1
            if j <= n and j - i >= max(3, 2 * unit):
                found.append((i, j, sum(map(_brute, value[i : i + unit])) + math.log10((j - i) / unit)))
    for test, first in ((lambda a, b: (a, b) in _NEAR, math.log10(47)), (lambda a, b: ord(b) - ord(a) == 1, 1.0), (lambda a, b: ord(a) - ord(b) == 1, 1.3)):
        i = 0
        while i < n:
            j = i + 1
            while j < n and test(low[j - 1], low[j]):
                j += 1
            if j - i >= 3:
                found.append((i, j, first + math.log10(j - i) + (0.5 * (j - i) if first > 1.5 else 0)))
            i = j
    return found


def guess_cost(value: str, ranks: Ranks) -> float:
    """log10 guesses of the cheapest segmentation: cost[end] = min of cost[start] + segment, single characters by force."""
    by_end: dict[int, list[tuple[int, float]]] = {}
    for i, j, cost in segments(value, ranks):
        by_end.setdefault(j, []).append((i, cost))
    cost = [0.0] * (len(value) + 1)
    for j in range(1, len(value) + 1):
        cost[j] = min([cost[j - 1] + _brute(value[j - 1]), *(cost[i] + c + _SEGMENT * (i > 0) for i, c in by_end.get(j, ()))])
    return cost[-1]


def _values(text: str) -> Iterator[tuple[int, int]]:
    """Where the values in credential contexts are, without closing punctuation."""
    for m in _CONTEXT.finditer(text):
        a, b = m.span(m.lastindex)
        b = a + len(text[a:b].rstrip(".:!?)]}"))
        if a < b:
            yield a, b


def _hinted(text: str) -> bool:
    low = text.lower()
    return any(h in low for h in _HINTS)


def scan(text: str, ranks: Ranks, least: float = LEAST) -> list[tuple[int, int, str, float | None]]:
    """All spans of a text as (start, end, kind, log10 guesses of a guess span), by start, then kind in order of KINDS."""
    hinted = _hinted(text)
    spans = [(*m.span(), "assign", None) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if hinted else []
    if "AKIA" in text:
        spans += [(*m.span(), "access", None) for m in ACCESS.finditer(text)]
    spans += [(*m.span(), "hex", None) for m in HEX.finditer(text)]
    if hinted:
        spans += [(a, b, "guess", cost) for a, b in _values(text) if (cost := guess_cost(text[a:b], ranks)) >= least]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    rows = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
    for batch in batches:
        for text in texts(batch["text"]):
            prose = text.as_py()
            if _hinted(prose):  # a value is no word of the dictionary for being there
                ends = [0, *(x for span in _values(prose) for x in span), len(prose)]
                prose = " ".join(prose[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
            counts.update(_WORD.findall(prose.lower()))
            if len(counts) > HELD:
                yield rows()
                counts.clear()
    yield rows()


def learn_words(docs: DataFrame, text: str = "text", most: int = DICTIONARY) -> list[str]:
    """The corpus's most frequent words (of 3 to 24 letters, in lower case), most frequent first, ties by code point.

    Counts are put into classes of an eighth of a doubling each. The dictionary has all words of as many classes, from
    the top, as hold no more than `most` words, and is filled up from the next class, which is ranked by ranges. So the
    driver gets one row for each class, then `most` words.
    """
    counted = map_arrow(docs.select(F.col(text).alias("text")), _count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = materialize(counted.withColumn("class", F.floor(8 * F.log2("n")).cast("int")), "words")
    held, split = 0, -1  # counts of one or more have classes from 0
    for r in sorted(counted.groupBy("class").agg(F.count("*").alias("words")).collect(), reverse=True):
        if held + r["words"] > most:
            split = r["class"]
            break
        held += r["words"]
    found = counted.filter(F.col("class") > split).select("word", "n").collect() if held else []
    if held < most and split >= 0:
        ranked = rank_rows(counted.filter(F.col("class") == split).select("word", "n"), F.col("n").desc(), F.col("word"))
        found += ranked.filter(F.col("rank") < most - held).select("word", "n").collect()
    return [r["word"] for r in sorted(found, key=lambda r: (-r["n"], r["word"]))]


def _scan(shared: object, least: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = Ranks(shared.value)
        for batch in batches:
            found = [scan(t, ranks, least) for t in texts(batch["text"]).to_pylist()]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("guesses", pa.float64())]))
            spans = pa.array([[{"kind": k, "start": a, "end": b, "guesses": g} for a, b, k, g in s] for s in found], kind)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], spans], ["doc_id", "spans"])

    return run


def find_secrets(docs: DataFrame, words: list[str] | None = None, text: str = "text", doc_id: str = "doc_id", least: float = LEAST) -> DataFrame:
    """One row for each row of docs: doc_id, spans (array of kind, start, end, guesses). words: from learn_words()."""
    shared = docs.sparkSession.sparkContext.broadcast(words or [])  # DICTIONARY words at most
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(rows, _scan(shared, least), "doc_id long, spans array<struct<kind: string, start: long, end: long, guesses: double>>")


def digest_spans(found: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the fixed patterns' spans, all spans as text, and the most guesses of any value."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    number = {f"n_{k}": count(k) for k in KINDS}
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return found.select(
        "doc_id", *(n.alias(k) for k, n in number.items()), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        F.array_max(F.transform("spans", lambda s: s["guesses"])).alias("max_guesses"),
    )
