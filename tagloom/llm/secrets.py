"""Secret scans: fixed patterns, and Markov models for what they miss.

Base kinds, each leftmost and non-overlapping over a text: ``assign`` (a name
such as token or password, a separator, a value of 6 or more characters),
``access`` (AKIA keys of 20 or more) and ``hex`` (runs of 24 or more).

The method adds kind ``random``: two order-1 character Markov models, one of
random strings and one of ordinary identifiers, score every free-standing run
of token characters; base spans are cut out of it, and each part left that has
16 or more characters is scored. A part whose log-likelihood ratio is high
enough in total and per character is added.

Both classes are learnt from labelled samples of two sources. ``samples`` makes
the one by rule from a fixed seed: keys over the usual alphabets are random;
names put together from common words in the usual styles, paths, UUIDs,
numbers and alphabets are ordinary. The corpus gives the other: values of base
spans are random; other runs of 6 or more token characters, and its words put
together in the same styles, are ordinary. In either class the corpus weighs at
most as much as the made samples, so prose without one identifier does not
drown them. About ``max_train_docs`` different texts, drawn by their hash and
each counted once however often it is copied, are read for it; Spark sums the
transition counts, and at most 2 x 67 x 67 of them reach the driver. Either
class is smoothed towards its character frequencies.

Defined results: null texts are empty and have no span; ids may repeat or be
null, a row of result for each row; offsets are code points, end exclusive;
texts of any length are scanned whole, in one pass; an empty table gives no row
and a model of the made samples alone; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, pieces

KINDS = ["assign", "access", "hex", "random"]
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{6,}")
LONG_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
CODE = np.zeros(128, np.int64)
CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
WORD = re.compile(r"[A-Za-z]{2,}")
MASK = "[REDACTED]"

#: common words of names in code, links and file systems (labelled ordinary)
NAME_WORDS = """
account active add address admin agent allow api app archive array async auth backup base batch block board buffer build byte cache call
category check child class client cluster code com common config content context control core count create current customer daily data date
default delete dev device document download edit email engine error event example export factory field file filter flag folder foo bar format
function get global group guide header health height help home host html http https icon id image impl import index info input internal item
java job json key label language length level library license limit link list load local lock log main manager map max memory message method
min mode model module mount name network node number object option order org output page parent password path payment plugin port prefix
print process profile project proxy public python query queue rate record remote report request reset response result retry root route run
schema score search server service session set shared size source state string system table test token type update url user util value
version view web wiki window work write year zone
""".split()


@dataclass(frozen=True)
class Params:
    max_train_docs: int = 20_000
    #: pseudo-counts a character of the uniform prior of either class
    random_prior: float = 4.0
    ordinary_prior: float = 0.5
    #: a run is added from this log-likelihood ratio on: in all, and a transition
    min_total: float = 16.0
    min_mean: float = 0.9
    #: and so many different characters: lines of one sign are no secrets
    min_distinct: int = 8


@dataclass(frozen=True)
class Model:
    ratio: np.ndarray  # log P(next | prev, random) - log P(next | prev, ordinary)
    params: Params

    def score(self, run: str) -> tuple[float, float]:
        """Log-likelihood ratio of a run: total, and a transition."""
        c = CODE[np.frombuffer(run.encode("ascii"), np.uint8)]
        total = float(self.ratio[c[:-1], c[1:]].sum())
        return total, total / max(1, len(c) - 1)

    def is_random(self, run: str) -> bool:
        total, mean = self.score(run)
        return total >= self.params.min_total and mean >= self.params.min_mean and len(set(run)) >= self.params.min_distinct


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind number, end, value start, value end), by start then kind."""
    found = [(m.start(), 0, m.end(), m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end(), m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def uncovered(runs: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs (ascending) that overlap none of the spans (ascending by start)."""
    out, k, reach = [], 0, -1
    for a, b in runs:
        while k < len(spans) and spans[k][0] < b:
            reach = max(reach, spans[k][1])
            k += 1
        if reach <= a:
            out.append((a, b))
    return out


def parts_left(runs: list[tuple[int, int]], spans: list[tuple[int, int]], least: int = 16) -> list[tuple[int, int]]:
    """What the spans (ascending by start) leave of the runs (ascending), in
    parts of ``least`` or more characters."""
    out, k, at = [], 0, 0
    for a, b in runs:
        at = max(at, a)
        while k < len(spans) and spans[k][0] < b:
            if spans[k][0] - at >= least:
                out.append((at, spans[k][0]))
            at = max(at, spans[k][1])
            k += 1
        if b - at >= least:
            out.append((at, b))
    return out


def all_spans(text: str, model: Model) -> list[tuple[int, int, int, int, int]]:
    base = base_spans(text)
    runs = [m.span() for m in LONG_RUN.finditer(text)]
    added = [(a, 3, b, a, b) for a, b in parts_left(runs, [(s[0], s[2]) for s in base]) if model.is_random(text[a:b])] if runs else []
    return sorted(base + added) if added else base


def styled(words: list[str], k: int) -> str:
    """The words as one name, in the k-th of the usual styles."""
    if k == 0:
        return "_".join(words).lower()
    if k == 1:
        return "_".join(words).upper()
    if k == 2:
        return words[0].lower() + "".join(w.capitalize() for w in words[1:])
    if k == 3:
        return "".join(w.capitalize() for w in words)
    if k == 4:
        return "-".join(words).lower()
    if k == 5:
        return "/".join(words).lower()
    if k == 6:
        return "_".join(w.capitalize() for w in words)
    return "/".join([*words[:-1], styled(words, 3)]).lower() if len(words) < 3 else "/".join([*(w.lower() for w in words[:-2]), styled(words[-2:], 3)])


STYLES = 8


def names_of(text: str) -> list[str]:
    """The words of a text, put together by three in the styles in turn."""
    words = WORD.findall(text)
    return [styled(words[i:i + 3], (i // 3) % STYLES) for i in range(0, len(words), 3)]


def samples(seed: int, n: int = 12_000) -> tuple[list[str], list[str]]:
    """(random, ordinary) labelled strings, made by rule from a seed."""
    r = random.Random(seed)
    kinds = [ALPHABET[:62], ALPHABET[:62], ALPHABET[:64], ALPHABET[:62] + "_-", ALPHABET[:26] + ALPHABET[52:62], ALPHABET[26:62]]
    keys = ["".join(r.choices(kinds[i % len(kinds)], k=r.randint(16, 44))) for i in range(n)]
    names = []
    for i in range(n):
        name = styled(r.choices(NAME_WORDS, k=r.randint(2, 5)), i % STYLES)
        names.append(name + r.choice(["", "", "", "", "_%d", "-%d", "%d", "/%d", "=%d"]).replace("%d", str(r.randrange(10 ** r.randint(1, 4)))))
    for i in range(n // 20):  # UUIDs, dates, numbers, lines and alphabets
        u = str(uuid.UUID(int=r.getrandbits(128)))
        names += [u if i % 4 else u.upper(), f"{r.randint(1990, 2035)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(0, 23):02}-{r.randint(0, 59):02}", str(r.getrandbits(64)), "-=_/+"[i % 5] * 20]
        names += [ALPHABET[:26], ALPHABET[26:52], ALPHABET[52:62]]
    return keys, names


def pairs_in(runs: list[str]) -> np.ndarray:
    """Counts [prev, next] inside the runs."""
    size = len(ALPHABET)
    # a byte that is no token character parts the runs
    c = np.frombuffer("\x00".join(runs).replace(".", "\x00").encode("ascii"), np.uint8)
    inside = (c[:-1] != 0) & (c[1:] != 0)
    return np.bincount(CODE[c[:-1][inside]] * size + CODE[c[1:][inside]], minlength=size * size).reshape(size, size)


def transitions(texts: list[str], named: bool = False) -> np.ndarray:
    """Counts [class, prev, next] over the labelled runs of texts; class 1 is
    random. ``named`` adds the names made of a text's words to class 0."""
    counts = np.zeros((2, len(ALPHABET), len(ALPHABET)), np.int64)
    for text in texts:
        base = base_spans(text)
        counts[1] += pairs_in([text[s[3]:s[4]] for s in base])
        plain = uncovered([m.span() for m in RUN.finditer(text)], [(s[0], s[2]) for s in base])
        counts[0] += pairs_in([text[a:b] for a, b in plain] + (names_of(text) if named else []))
    return counts


def with_samples(counts: np.ndarray) -> np.ndarray:
    """Counts of the made samples and, weighing at most as much, of the corpus."""
    keys, names = samples(1)
    made = np.stack([pairs_in(names), pairs_in(keys)]).astype(float)
    for label in range(2):
        made[label] += counts[label] * min(1.0, made[label].sum() / max(counts[label].sum(), 1))
    return made


def train(docs: DataFrame, params: Params = Params(), *, text_col: str = "text") -> Model:
    texts = docs.select(F.col(text_col).alias("text")).where("text IS NOT NULL").withColumn("digest", F.xxhash64("text", F.lit("secrets")))
    total = texts.agg(F.approx_count_distinct("digest").alias("n")).first()["n"]
    share = min(1.0, params.max_train_docs / max(total, 1))
    drawn = texts.where(F.pmod("digest", F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = drawn.groupBy("digest").agg(F.first("text").alias("text")).select("text")  # copies meet map-side
    schema = pa.schema([("label", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(ALPHABET), len(ALPHABET)), np.int64)
        for b in pieces(batches):
            total += transitions(b.column("text").to_pylist(), named=True)
        at = np.nonzero(total)
        yield batch_of(schema, [*at, total[at]])

    total = np.zeros((2, len(ALPHABET), len(ALPHABET)))
    for r in rows.mapInArrow(count, "label int, a int, b int, n long").groupBy("label", "a", "b").agg(F.sum("n").alias("n")).collect():
        total[r["label"], r["a"], r["b"]] = r["n"]
    return from_counts(with_samples(total), params)


def from_counts(counts: np.ndarray, params: Params = Params()) -> Model:
    """Transition probabilities of either class, smoothed towards the class's
    own character frequencies (themselves smoothed towards uniform), so that a
    character never seen in ordinary runs counts whatever stands before it."""
    logs = []
    for n, prior in zip(counts, (params.ordinary_prior, params.random_prior)):
        size = len(ALPHABET)
        each = n.sum(axis=0) + prior
        strength = prior * size
        logs.append(np.log((n + strength * each / each.sum()) / (n.sum(axis=1, keepdims=True) + strength)))
    return Model(logs[1] - logs[0], params)


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _, _ in spans)


def scan(spark: SparkSession, docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans) for every row."""
    shared = spark.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_random", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            found = [all_spans(t, shared.value) for t in b.column("text").to_pylist()]
            yield batch_of(schema, [b.column("doc_id"), *([sum(s[1] == k for s in x) for x in found] for k in range(4)),
                                    [hashlib.sha256(written([s for s in x if s[1] < 3]).encode()).hexdigest() for x in found], [written(x) for x in found]])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def masked(text: str | None, model: Model) -> str | None:
    """The text with the value of every span replaced by a mark."""
    cuts = sorted((s[3], s[4]) for s in all_spans(text, model)) if text else []
    if not cuts:
        return text
    out, at = [], 0
    for a, b in cuts:
        if a >= at:
            out += [text[at:a], MASK]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(spark: SparkSession, docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs``, all rows and columns, with the secrets in the text masked;
    ``n_chars``, where there is one, follows the new text."""
    shared = spark.sparkContext.broadcast(model)
    at, names = docs.columns.index(text_col), docs.columns
    sized = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            old = b.column(at).to_pylist()
            new = [masked(t, shared.value) for t in old]
            cols = list(b.columns)
            cols[at] = pa.array(new, b.schema.field(at).type)
            if sized is not None:
                cols[sized] = pa.array([n if a is t else len(t) for n, a, t in zip(b.column(sized).to_pylist(), old, new)], b.schema.field(sized).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
