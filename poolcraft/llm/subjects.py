"""Subject areas of documents by anchored non-negative matrix factorisation (problem 9).

The rows of the matrix are the documents, held sentence by sentence, its columns their words. It is factored into
subject mixtures and subject vocabularies by alternating multiplicative updates for the Kullback-Leibler divergence.
One component is anchored to each subject: its vocabulary starts from the words that are more
frequent in the documents people gave that label (and from the words of the subject's description), and each update pulls it
back towards them; one component, started from all words, takes what every text has. So the components keep their names, and
a sentence's mixture says what it is about.

Texts are read once, into codes of their words. The VOCABULARY most frequent words have a column each, all others share OTHERS columns by their code, so no word is
left out and the matrix's width is bounded. Equal sentences are one row with a multiplicity, as
nothing in an update depends on the document. An update is one pass over these rows: a task holds the vocabularies (components x columns numbers) and returns
its share of the next ones; the sum has the same bounded size, whatever the number of documents.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolcraft.session import cut_lineage

#: Words with a column of their own, and columns that the others share (10 subjects: 5 MB).
VOCABULARY, OTHERS = 50_000, 1 << 16
#: Most updates, and the change of every vocabulary (of 2 at most) that ends them.
UPDATES, SETTLED = 12, 0.002
#: Passes over a sentence for its mixture.
INNER = 8
#: Terms that are handled at a time.
CHUNK = 60_000
#: Words that a document's mixture counts for in each of its sentences.
PRIOR = 2.0
#: Weight of the anchors, as a share of a component's mass, in every update.
ANCHOR = 0.3
#: A word is a subject's own above this share of its labelled occurrences (at least twice the even one, where subjects are few);
#: EVEN occurrences are added, spread evenly.
LEAST_OWN, EVEN = 0.44, 2.0
#: Weight of a subject's description against its labels, and labelled words at which half of what it has beyond LEAST_HINT is left.
HINT, LEAST_HINT, HEARD = 0.3, 0.01, 50.0
#: Labelled occurrences at which half the weight of what the labels say about a word is believed.
BELIEVED = 10.0
#: A sentence has a subject when its mixture holds so many words of subjects at least, and one subject this share of them.
LEAST_WORDS, LEAST_LEAD = 0.6, 0.5
#: A document is about a subject that this share of its sentences with a subject are about.
QUARTER = Fraction(1, 4)

_WORD = re.compile(r"[^\W\d_]{3,}(?:['’-][^\W\d_]+)*")
_LINE = re.compile(r"[\r\n\v\f\x85\u2028\u2029]+")
_END = re.compile(r"(?<=[.!?;])\s+")
#: A list item without a full stop, followed by a sentence: a capital after a small letter, but not a name after a preposition.
_ITEM_END = re.compile(r"(?<=[a-z]) (?=[A-Z][a-z]+ )")
_PREPOSITIONS = frozenset("in at of on to by an or the near from a for with and".split())
_BROKEN = re.compile("[\u00c2-\u00f4][\u0080-\u00bf\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013-\u203a\u20ac\u2122]+")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")


def _mended(m: re.Match) -> str:
    for code in ("cp1252", "latin-1"):
        try:
            return m[0].encode(code).decode()
        except UnicodeError:
            pass
    return m[0]


def _items(item: str) -> list[str]:
    parts, start = [], 0
    for m in _ITEM_END.finditer(item):
        if item[start : m.start()].rpartition(" ")[2] not in _PREPOSITIONS:
            parts.append(item[start : m.start()])
            start = m.end()
    return [*parts, item[start:]]


def sentences(text: str) -> list[list[str]]:
    """Lower-case words of each sentence or list item of a text; broken encodings mended, invisible characters dropped."""
    text = unicodedata.normalize("NFC", _INVISIBLE.sub("", _BROKEN.sub(_mended, text)))
    return [words for line in _LINE.split(text) for words in _of_line(line)]


def _of_line(line: str) -> list[list[str]]:
    found = []
    for sentence in _END.split(line):
        parts = _items(sentence) if sentence[:2] in ("- ", "* ", "• ") else [sentence]
        found += (words for part in parts if (words := _WORD.findall(part.lower())))
    return found


def code_of(word: str) -> int:
    return xxhash.xxh32_intdigest(word) - (1 << 31)


class Columns:
    """Codes of words to columns: the place among the listed codes, or behind them one of OTHERS."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes, self.count = np.sort(codes).astype(np.int32), len(codes) + OTHERS

    def __call__(self, terms: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return terms.astype(np.int64) % OTHERS
        at = np.searchsorted(self.codes, terms)
        own = self.codes[np.minimum(at, len(self.codes) - 1)] == terms
        return np.where(own, at, len(self.codes) + terms.astype(np.int64) % OTHERS)


class Reader:
    """Text to the codes of its sentences' words, each once a sentence; the same as :func:`sentences`, with a memory for tokens between blanks."""

    def __init__(self) -> None:
        self._seen: dict[str, tuple[list[int], bool]] = {}

    def __call__(self, text: str) -> list[list[int]]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", _INVISIBLE.sub("", _BROKEN.sub(_mended, text)))
        if len(self._seen) > 500_000:
            self._seen.clear()
        seen, found = self._seen, []
        for line in _LINE.split(text):
            if "- " in line or "* " in line or "• " in line:  # list items, perhaps
                found += (list(dict.fromkeys(map(code_of, words))) for words in _of_line(line))
                continue
            columns: list[int] = []
            for token in line.lower().split():
                known = seen.get(token)
                if known is None:
                    known = seen[token] = ([code_of(w) for w in _WORD.findall(token)], token[-1] in ".!?;")
                columns += known[0]
                if known[1] and columns:
                    found.append(list(dict.fromkeys(columns)))
                    columns = []
            if columns:
                found.append(list(dict.fromkeys(columns)))
        return found


def matrix(documents: DataFrame) -> DataFrame:
    """(key, lengths, terms): the sentences of each document as codes of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader()
        for batch in batches:
            lengths, terms, sentences_, words = [], [], [0], [0]
            for text in batch.column(1).to_pylist():
                rows = read(text)
                lengths += map(len, rows)
                terms += chain.from_iterable(rows)
                sentences_.append(len(lengths))
                words.append(len(terms))
            columns = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.array(flat, dtype=np.int32))) for at, flat in ((sentences_, lengths), (words, terms))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["key", "lengths", "terms"])

    return documents.select("key", "text").mapInArrow(run, "key bigint, lengths array<int>, terms array<int>")


def distinct_sentences(rows: DataFrame) -> DataFrame:
    """(terms, n): the different sentences of all documents, as packed codes in order, and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            terms, row, _ = _unpacked(batch)
            ordered = np.sort((row.astype(np.int64) << 32) | (terms.astype(np.int64) & 0xFFFFFFFF))
            ends = np.cumsum(np.bincount(row)).tolist() if len(row) else []
            packed = (ordered & 0xFFFFFFFF).astype(np.uint32).tobytes()
            counts.update(packed[4 * a : 4 * b] for a, b in zip([0, *ends[:-1]], ends, strict=True))
            if len(counts) > 500_000:
                yield _counted(counts)
                counts = Counter()
        if counts:
            yield _counted(counts)

    return rows.select("key", "lengths", "terms").mapInArrow(run, "terms binary, n bigint").groupBy("terms").agg(F.sum("n").alias("n"))


def vocabulary(distinct: DataFrame) -> Columns:
    """The VOCABULARY words in most sentences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, row, n = _all_of(batch)
            codes, at = np.unique(terms, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int32()), pa.array(np.bincount(at, weights=n[row], minlength=len(codes)).astype(np.int64))], names=["code", "n"])

    counted = distinct.mapInArrow(run, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    return Columns(np.array([r.code for r in counted.orderBy(F.desc("n"), "code").limit(VOCABULARY).collect()], dtype=np.int32))


def _counted(counts: Counter[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["terms", "n"])


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms, sentence of each term, and document of each sentence of a batch (key, lengths, terms)."""
    lengths, terms = batch.column(1), batch.column(2)
    flat = lengths.flatten().to_numpy(zero_copy_only=False)
    per_document = np.diff(lengths.offsets.to_numpy())
    return terms.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(flat)), flat), np.repeat(np.arange(len(batch)), per_document)


def mixtures(p: np.ndarray, sizes: np.ndarray, prior: np.ndarray | None = None, parts: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Words of each component in each row, and (if wanted) the part of each component in each term, for the vocabularies at the terms.

    ``p``: [term, component], row by row; ``sizes``: terms per row. With a ``prior`` a row's mixture is drawn towards it, as PRIOR more words would: a word that may
    belong to a subject counts for it where the document speaks of it elsewhere, or nothing else explains the word. Rows of about the same size are handled together, as one dense block.
    """
    k = p.shape[1]
    held, part = np.zeros((len(sizes), k), dtype=np.float32), np.zeros_like(p) if parts else None
    padded = np.vstack([p, np.zeros((1, k), dtype=p.dtype)])  # what fills a row up to its block's size
    starts = np.cumsum(sizes) - sizes
    step = np.where(sizes <= 12, 1, np.where(sizes <= 32, 4, 16))
    rounded = -(-sizes // step) * step
    more = np.float32(0 if prior is None else PRIOR)
    for size in np.unique(rounded[rounded > 0]).tolist():
        rows = np.flatnonzero(rounded == size)
        at = np.arange(size) + starts[rows, None]
        at[np.arange(size) >= sizes[rows, None]] = len(p)
        block = padded[at]
        drawn = np.full((len(rows), k), 1 / k, dtype=np.float32) if prior is None else prior[rows]
        w, whole = drawn + np.float32(1e-3), (sizes[rows, None] + more).astype(np.float32)
        for _ in range(INNER):
            inverse = 1 / np.maximum(np.einsum("slk,sk->sl", block, w), np.float32(1e-30))
            last, found = w, w * np.einsum("slk,sl->sk", block, inverse)
            w = (found + more * drawn) / whole
        held[rows] = found
        if parts:
            real = at < len(p)
            part[at[real]] = (block * last[:, None, :] * inverse[:, :, None])[real]
    return held, part


def _chunks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of rows with about CHUNK terms each."""
    at, ends = 0, np.cumsum(sizes)
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        yield at, stop
        at = stop


def _sum_of(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sum of tasks' (k, t, v) as an array; at most components x columns rows."""
    summed = parts.groupBy("k", "t").agg(F.sum("v").alias("v")).toPandas()
    found = np.zeros(shape)
    found[summed["k"], summed["t"]] = summed["v"]
    return found


def _sparse(total: np.ndarray) -> pa.RecordBatch:
    k, t = np.nonzero(total > 1e-9)
    return pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(t, pa.int32()), pa.array(total[k, t], pa.float64())], names=["k", "t", "v"])


def _all_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms, row of each term and multiplicity of each row of a batch (terms, n)."""
    codes = batch.column(0)
    sizes = np.diff(np.frombuffer(codes.buffers()[1], dtype=np.int32, count=len(codes) + codes.offset + 1)[codes.offset :]) // 4
    return np.frombuffer(b"".join(codes.to_pylist()), dtype=np.int32), np.repeat(np.arange(len(codes)), sizes), batch.column(1).to_numpy()


def _held(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same in chunks."""
    _, row, _ = _all_of(batch)
    for a, b in _chunks(np.bincount(row, minlength=len(batch))):
        yield _all_of(batch.slice(a, b - a))


def in_columns(distinct: DataFrame, columns: Columns) -> DataFrame:
    """``distinct`` with columns instead of codes."""
    shared = distinct.sparkSession.sparkContext.broadcast(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, row, _ = _all_of(batch)
            packed, ends = shared.value(terms).astype(np.int32).tobytes(), np.cumsum(np.bincount(row, minlength=len(batch))).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([packed[4 * a : 4 * b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], pa.binary()), batch.column(1)], names=["terms", "n"])

    return distinct.mapInArrow(run, "terms binary, n bigint")


def frequencies(distinct: DataFrame, width: int) -> np.ndarray:
    """Occurrences of every column, a sentence counting each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1, width))
        for batch in batches:
            for terms, row, n in _held(batch):
                total[0] += np.bincount(terms, weights=n[row], minlength=width)
        yield _sparse(total)

    return _sum_of(distinct.mapInArrow(run, "k int, t int, v double"), (1, width))[0]


def _update(distinct: DataFrame, h: np.ndarray) -> np.ndarray:
    """Next vocabularies before scaling: the parts of every component in every term, over all documents."""
    shared = distinct.sparkSession.sparkContext.broadcast(np.ascontiguousarray(h.T, dtype=np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies = shared.value
        size = vocabularies.shape[1]
        total = np.zeros(vocabularies.size)
        for batch in batches:
            for terms, row, n in _held(batch):
                _, part = mixtures(vocabularies[terms], np.bincount(row, minlength=len(n)), parts=True)
                part *= n[row, None].astype(np.float32)
                columns, at = np.unique(terms, return_inverse=True)
                spread = np.bincount((at[:, None] * size + np.arange(size)).ravel(), weights=part.ravel(), minlength=len(columns) * size)
                total.reshape(-1, size)[columns] += spread.reshape(-1, size)
        yield _sparse(total.reshape(-1, size).T)

    found = _sum_of(distinct.mapInArrow(run, "k int, t int, v double"), h.shape)
    shared.destroy()
    return found


def anchors(rows: DataFrame, columns: Columns, overall: np.ndarray, labels: DataFrame, names: list[str], descriptions: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starting vocabularies of the subjects and of what all texts have; how far each word may be in each component.

    A subject's words are those with a large share of their labelled occurrences (at even sizes of the labels) in documents
    labelled with it; wrong labels are spread over all subjects and stay below the bar. Every label counts, whoever gave it.
    """
    clean = labels.select(F.col("doc_id").alias("key"), F.lower(F.trim("subject")).alias("subject")).filter(F.col("key").isNotNull() & F.col("subject").isin(*names)).distinct()
    shared = rows.sparkSession.sparkContext.broadcast(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), columns.count))
        for batch in batches:
            terms = batch.column(1)
            of = np.repeat([names.index(x) for x in batch.column(0).to_pylist()], np.diff(terms.offsets.to_numpy()))
            np.add.at(total, (of, shared.value(terms.flatten().to_numpy(zero_copy_only=False))), 1)
        yield _sparse(total)

    seen = _sum_of(rows.join(clean, "key").select("subject", "terms").mapInArrow(run, "k int, t int, v double"), (len(names), columns.count))
    rates = seen / np.maximum(seen.sum(1, keepdims=True), 1)
    # Share of each subject in a word; words with few labelled occurrences count as evenly spread, as far as they are few.
    labelled = seen.sum(0)
    share = (rates / np.maximum(rates.sum(0), 1e-12) * labelled + EVEN / len(names)) / (labelled + EVEN)
    least = max(LEAST_OWN, min(0.5, 2 / len(names)))
    own = np.maximum(0, share - least) / (1 - least)
    # Words that the labels show to be common, or another subject's, are kept out of a component as far as the labels are believed; the others are
    # left to the updates.
    belief = labelled / (labelled + BELIEVED)
    gate = np.vstack([1 - belief * (1 - np.minimum(1, own / 0.05)), 1 - belief * own.max(0)])
    start = overall * own
    common = overall * (1 - own.max(0)) ** 2
    common /= max(common.sum(), 1e-9)
    for k, (name, text) in enumerate(zip(names, descriptions, strict=True)):
        told = [code_of(w) for words in sentences(f"{name}. {text}") for w in words]
        hints = [i for i in columns(np.array(told, dtype=np.int32)).tolist() if overall[i] > 1e-9]
        start[k] /= max(start[k].sum(), 1e-9)
        for i in hints:
            start[k, i] += (LEAST_HINT + (HINT - LEAST_HINT) * HEARD / (HEARD + seen[k].sum())) / len(hints)
    return start / np.maximum(start.sum(1, keepdims=True), 1e-9), common, gate


def factor(distinct: DataFrame, start: np.ndarray, common: np.ndarray, gate: np.ndarray, overall: np.ndarray) -> np.ndarray:
    """Vocabularies of the subjects and, last, of what all texts have; each sums to 1."""
    anchor = np.vstack([start, common])
    h = 0.9 * anchor + 0.1 * overall * gate
    for _ in range(UPDATES):
        total = _update(distinct, h) * gate
        last, h = h, (1 - ANCHOR) * total / np.maximum(total.sum(1, keepdims=True), 1e-9) + ANCHOR * anchor
        h = 0.999 * h + 0.001 * overall * gate
        if np.abs(h - last).sum(1).max() < SETTLED:
            break
    return h


def subjects_of_documents(documents: DataFrame, areas: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, subject): the subjects of each document of ``documents`` (doc_id, text); none, one or several.

    Null and empty texts have none; an unlabelled collection is anchored by the descriptions only. ``areas`` (subject, description)
    is the fixed list of subjects. Rows are distinct.
    """
    listed = sorted((r.subject.strip().lower(), r.subject, r.description or "") for r in areas.select("subject", "description").collect() if r.subject)
    names, written = [x[0] for x in listed], [x[1] for x in listed]
    held = documents.filter("doc_id IS NOT NULL AND text <> ''").select(F.col("doc_id").alias("key"), "text")
    rows = cut_lineage(matrix(held))
    coded = cut_lineage(distinct_sentences(rows))
    columns = vocabulary(coded)
    if not names or columns.count == OTHERS:  # no word at all
        return held.sparkSession.createDataFrame([], "doc_id bigint, subject string")
    distinct = cut_lineage(in_columns(coded, columns))
    overall = frequencies(distinct, columns.count) + 1e-9
    overall /= overall.sum()
    start, common, gate = anchors(rows, columns, overall, labels, names, [x[2] for x in listed])
    h = factor(distinct, start, common, gate, overall)
    shared = held.sparkSession.sparkContext.broadcast((np.ascontiguousarray(h.T, dtype=np.float32), columns, written))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies, place, subjects = shared.value
        for batch in batches:
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            for a, b in _chunks(sizes):
                piece = batch.slice(a, b - a)
                terms, row, group = _unpacked(piece)
                d, k = np.nonzero(judged(vocabularies[place(terms)], np.bincount(row, minlength=len(group)), group, b - a))
                keys = piece.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(keys[d], pa.int64()), pa.array([subjects[i] for i in k], pa.string())], names=["doc_id", "subject"])

    return rows.mapInArrow(run, "doc_id bigint, subject string").distinct()


def judged(p: np.ndarray, sizes: np.ndarray, group: np.ndarray, documents: int) -> np.ndarray:
    """[document, subject]: the document is about the subject. ``group``: the document of each sentence, ``sizes`` its terms."""
    k = p.shape[1] - 1
    votes = np.zeros((documents, k), dtype=np.int64)
    if len(p):
        whole, _ = mixtures(p, np.bincount(group, weights=sizes, minlength=documents).astype(np.int64))
        held, _ = mixtures(p, sizes, (whole / np.maximum(whole.sum(1, keepdims=True), 1e-9))[group])
        subject = held[:, :k]
        total, best = subject.sum(1), subject.argmax(1)
        about = (total >= LEAST_WORDS) & (subject.max(1) >= LEAST_LEAD * total)
        np.add.at(votes, (group[about], best[about]), 1)
    said = votes.sum(1, keepdims=True)
    return (votes > 0) & (votes * QUARTER.denominator >= said * QUARTER.numerator)
