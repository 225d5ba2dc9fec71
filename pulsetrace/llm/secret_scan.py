"""Secrets in texts: fixed patterns, and character Markov models of random strings and ordinary identifiers.

The models are first-order chains over one alphabet. Samples labelled ordinary are all runs of the corpus outside
the matches of the patterns, but for long runs, which are what the models are to judge, and a seeded set of
identifiers, most of them with digits, paths and dates; samples labelled random are the patterns' matches and a
seeded set of uniformly random strings over the usual alphabets, letters alone and digits alone among them. Character
pairs are counted in Arrow batches, summed by Spark, and only the two fixed-size tables reach the driver. Every run of
enough characters is scored, also what a pattern's match leaves of it, and a secret where the log-likelihood ratio of
random to ordinary exceeds the threshold of its shape (digits, small, large or both kinds of letters, anything). The
thresholds are learned: all but a small share of further labelled ordinary runs stay below. Ordinary numbers are as
random as secret ones, so next to no run of digits alone passes.

Defined cases. Null text: empty, no spans; ``redact`` leaves it null. Repeated rows: each its own row. Spans may
overlap between kinds; those of the model never overlap a pattern's. Empty table: empty result, models from the
seeded strings alone. Extra columns pass through ``redact`` untouched.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsetrace.llm.common import named, numbered, text_of

KINDS = ("assign", "access", "hex", "markov")
# The patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
#: Words without which the first pattern cannot match: a cheap test before it is run.
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

LETTERS = string.ascii_letters + string.digits + "+/_=-"
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
#: Alphabets with a threshold of their own, as a chain of pairs tells them apart with unequal ease.
SHAPES = (re.compile("[0-9]+"), re.compile("[a-z]+"), re.compile("[A-Z]+"), re.compile("[A-Za-z]+"))
STATES = len(LETTERS) + 1  # 0 is whatever is outside a run
CODE = np.zeros(256, np.uint8)
CODE[np.frombuffer(LETTERS.encode(), np.uint8)] = np.arange(1, STATES)
#: Words that names in code, paths and links are commonly made of.
NAMES = """account action active add address admin after agent alert all api app apply archive area array article asset
    attribute author auto available back background bar base batch before begin block blog body book bool border bottom box
    branch buffer build button byte cache calendar call camera cancel capture card cart case category cell center chain change
    channel char chart check child city class clean click client clock close cloud code collection color column command comment
    commit common company compare complete component config connect console contact container content context control cookie
    copy core count country create current customer daily dark data database date day debug decode default define delete delivery
    deploy design detail device dialog digest direct directory disable display document domain down download draft draw drive drop
    edge edit editor element email empty enable encode end engine entry error event exception execute export extend external
    factory fail feature feed field figure file filter find first fix flag float flow folder font footer force form format
    forum frame free from front full function game gateway general generate get global graph green grid group guide handle
    handler hash head header health height help history home hook host hour house html http icon identity image import
    index info init inline input insert install instance int interface internal invoice is item job join json jump kernel key
    keyboard kind label language large last latest layer layout left legacy length level library license light limit line
    link list load local location lock log login long loop machine mail main manager map margin market mask master match max
    media member memory menu merge message meta method min mobile mode model module monitor month mouse move music name native
    network new news next node normal note notification null number object offer offset old on open option order origin other
    output overview owner package page paint panel parent parse part partner pass patch path pattern payment people percent
    phone photo picture pixel place plan player plugin point policy pool popup port position post power prefix press price
    print privacy process product profile program project promise property provider proxy public publish purchase query queue
    quick random range rate raw read ready record red reference region release reload remote remove render replace report
    request require reset resize resource response result return review right role room root route row rule run safe sale sample
    save scale schema score screen script scroll search second section security select send sensor series server service
    session set setting setup shadow share shift shop short show side sign simple single site size sketch slice small social
    sort source space special split stack staff stage standard start state static station status step stop storage store story
    stream street string style submit success summary support swap switch symbol sync system tab table tag target task
    team template term test text theme thread thumb ticket time title toggle tool top topic total track trade traffic
    transfer tree trigger type union unit update upload url use user util valid value vector version video view visible
    visit wait wall watch water web week weight welcome widget width window wizard word work world wrapper write year
    yellow young zero zone""".split()


@dataclass(frozen=True)
class Scan:
    """``false_share``: most of the labelled identifiers, none of which the models have seen, that may pass for secrets;
    it sets the least log-likelihood ratio, in nats, for each shape of run. ``limit``: most that one character adds or
    takes, so that a pair the corpus happens not to have decides nothing alone; ``least``: characters of a scored run, 16
    or more."""

    false_share: float = 0.001
    least: int = 16
    limit: float = 4.0
    prior: float = 10.0
    seed: int = 42
    samples: int = 5000
    mark: str = "[secret]"


def pairs(data: bytes) -> np.ndarray:
    """How often each pair of neighbouring characters occurs; both ends count as outside."""
    codes = CODE[np.frombuffer(b" " + data + b" ", np.uint8)].astype(np.int32)
    return np.bincount(codes[:-1] * STATES + codes[1:], minlength=STATES * STATES)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, leftmost and non-overlapping per kind."""
    found = []
    lower = text.lower()
    if (":" in text or "=" in text) and any(k in lower for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    for run in RUN.finditer(text):  # a hex run of 24 lies inside a run of 16
        if run.end() - run.start() >= MIN_HEX:
            found += [(m.start(), 2, m.end()) for m in HEX.finditer(text, run.start(), run.end())
                      if m.end() - m.start() >= MIN_HEX]
    return sorted(found)


def score(piece: bytes, ratio: np.ndarray) -> float:
    """Log-likelihood ratio of random to ordinary of one run."""
    codes = CODE[np.frombuffer(piece, np.uint8)]
    return float(ratio[codes[:-1], codes[1:]].sum())


def shape_of(piece: str) -> int:
    """Number of the first of ``SHAPES`` that the run has throughout, or their count."""
    return next((i for i, shape in enumerate(SHAPES) if shape.fullmatch(piece)), len(SHAPES))


def outside(start: int, end: int, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """The stretches of a run that no span covers; ``spans`` are sorted."""
    for s, _, e in spans:
        if s < end and start < e:
            if s > start:
                yield start, s
            start = max(start, e)
    if start < end:
        yield start, end


def all_spans(text: str, ratio: np.ndarray, thresholds: list[float], least: int = 16) -> list[tuple[int, int, int]]:
    """The patterns' spans and those that the models add: runs, or what the patterns leave of them."""
    found = base_spans(text)
    added = []
    for run in RUN.finditer(text):
        for start, end in outside(run.start(), run.end(), found):
            piece = text[start:end]
            if end - start >= least and score(piece.encode(), ratio) > thresholds[shape_of(piece)]:
                added.append((start, 3, end))
    return sorted(found + added)


def random_strings(settings: Scan) -> Iterator[bytes]:
    draw = random.Random(settings.seed)
    alphabets = ("0123456789abcdef", string.ascii_uppercase + "234567", string.ascii_letters + string.digits,
                 string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_",
                 string.ascii_letters, string.digits)
    for i in range(settings.samples):
        yield "".join(draw.choices(alphabets[i % len(alphabets)], k=draw.randint(20, 64))).encode()


def identifiers(settings: Scan, seed: int) -> Iterator[bytes]:
    """Labelled ordinary runs: names in the usual spellings, most of them with digits, paths and dates."""
    draw = random.Random(seed)
    for i in range(settings.samples):
        words = draw.choices(NAMES, k=draw.randint(3, 6))
        number = str(draw.choice((draw.randint(0, 9), draw.randint(10, 99), draw.randint(1900, 2099), 32, 64, 128, 256)))
        if draw.random() < 0.7:
            words.insert(draw.randint(1, len(words)), number)
        day = f"{draw.randint(1990, 2039)}{{0}}{draw.randint(1, 12):02}{{0}}{draw.randint(1, 28):02}"
        yield (lambda: "_".join(words), lambda: "-".join(words), lambda: "/".join(words), lambda: "_".join(words).upper(),
               lambda: "".join(w.title() for w in words), lambda: words[0] + "".join(w.title() for w in words[1:]),
               lambda: "".join(words), lambda: "-".join([*words, day.format("-")]), lambda: day.format("/") + "/" + "-".join(words),
               lambda: "_".join([*words, "v" + number]))[i % 10]().encode()


def ordinary_runs(settings: Scan, seed: int) -> Iterator[str]:
    """Labelled ordinary runs of every shape: identifiers, words run together, and numbers of any kind."""
    draw = random.Random(seed)
    for piece in identifiers(settings, seed):
        yield piece.decode()
    for i in range(settings.samples):
        words = "".join(draw.choices(NAMES, k=draw.randint(3, 8)))
        yield (words, words.upper(), words.title(), "".join(w.title() for w in draw.choices(NAMES, k=draw.randint(3, 6))))[i % 4]
        # Account, card, order and serial numbers are ordinary, and as random as any.
        yield "".join(draw.choices(string.digits, k=draw.randint(16, 40)))


def learned(ratio: np.ndarray, settings: Scan) -> list[float]:
    """Least ratio per shape: the score that all but ``false_share`` of the ordinary runs of that shape stay below."""
    scores: list[list[float]] = [[] for _ in range(len(SHAPES) + 1)]
    for piece in ordinary_runs(settings, settings.seed + 1):
        if len(piece) >= settings.least:
            scores[shape_of(piece)].append(score(piece.encode(), ratio))
    return [max(0.0, float(np.quantile(x, 1 - settings.false_share, method="higher"))) if x else 0.0 for x in scores]


def train(docs: DataFrame, settings: Scan = Scan()) -> tuple[np.ndarray, list[float]]:
    """Log-likelihood ratio of each character after each other one, from all texts, and the thresholds by shape."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, STATES * STATES), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                every = pairs(text.encode("utf-8", "surrogatepass"))
                known = merged(base_spans(text))
                for start, _, end in known:
                    piece = pairs(text[start:end].encode())
                    sums[1] += piece
                    every = every - piece
                for run in RUN.finditer(text):
                    for start, end in outside(run.start(), run.end(), known):
                        if end - start >= settings.least:  # scored, so no sample
                            every = every - pairs(text[start:end].encode())
                sums[0] += np.maximum(every, 0)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at // sums.shape[1]), pa.array(at % sums.shape[1]), pa.array(
            sums.ravel()[at])], names=["label", "pair", "n"])

    rows = docs.select(text_of().alias("text")).mapInArrow(count, "label long, pair long, n long")
    table, made = np.zeros((2, STATES * STATES)), np.zeros((2, STATES * STATES))
    # At most 2 * STATES**2 rows, whatever the corpus.
    for row in rows.groupBy("label", "pair").agg(F.sum("n").alias("n")).collect():
        table[row.label, row.pair] = row.n
    for piece in random_strings(settings):
        made[1] += pairs(piece)
    for piece in identifiers(settings, settings.seed):
        made[0] += pairs(piece)
    mix = np.zeros((2, STATES - 1, STATES - 1))
    for part in (table, made):  # half each, so that the seeded samples count alike beside any corpus
        part = part.reshape(2, STATES, STATES)[:, 1:, 1:]
        # Rarely seen characters lean on the single-character frequencies of their own model.
        single = part.sum(axis=1, keepdims=True) + 0.5
        part = part + settings.prior * single / single.sum(axis=2, keepdims=True)
        mix += part / part.sum(axis=2, keepdims=True) / 2
    chance = np.log(mix)
    ratio = np.zeros((STATES, STATES))
    ratio[1:, 1:] = np.clip(chance[1] - chance[0], -settings.limit, settings.limit)
    # A character repeated, as in a ruler, does not speak for a random string.
    np.fill_diagonal(ratio, np.minimum(ratio.diagonal(), 0))
    return ratio, learned(ratio, settings)


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans joined where they overlap, in order."""
    out: list[tuple[int, int, int]] = []
    for start, kind, end in sorted(spans):
        if out and start < out[-1][2]:
            out[-1] = (out[-1][0], out[-1][1], max(end, out[-1][2]))
        else:
            out.append((start, kind, end))
    return out


def scan(docs: DataFrame, settings: Scan = Scan()) -> DataFrame:
    """doc_id and ``found``, the document's spans as (kind, start, end) by start, then kind; code points."""
    ratio, thresholds = train(docs, settings)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in all_spans(t, ratio, thresholds, settings.least)]
                     for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "found"])

    return docs.select(named("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(
        run, "doc_id long, found array<struct<kind:string,start:int,end:int>>")


def redact(docs: DataFrame, settings: Scan = Scan()) -> DataFrame:
    """The documents with every span replaced by the mark; a column n_chars follows the text."""
    (ratio, thresholds), mark = train(docs, settings), settings.mark
    at = docs.columns.index("text")

    def clean(text: str | None) -> str | None:
        spans = merged(all_spans(text, ratio, thresholds, settings.least)) if text else []
        if not spans:
            return text
        parts, last = [], 0
        for start, _, end in spans:
            parts += [text[last:start], mark]
            last = end
        return "".join([*parts, text[last:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([clean(t) for t in columns[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    rows = numbered(docs)
    out = rows.mapInArrow(run, rows.schema).toDF(*docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return out
