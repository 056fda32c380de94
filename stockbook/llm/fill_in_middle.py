"""Fill-in-middle transformation by secondary-sort assembly.

A document is cut into units (its lines); two cuts, drawn from a hash of its
id, make prefix, middle and suffix, which are put out in the order of the
document's form, each behind its mark:

- psm: prefix mark, prefix, suffix mark, suffix, middle mark, middle;
- spm: suffix mark, suffix, prefix mark, prefix, middle mark, middle;
- plain: the text as it is.

No task builds an output text to do so. Every document is emitted as pieces,
runs of units of at most ``CHUNK`` characters (a longer unit in several
pieces), keyed by (row, output position). One shuffle by row with a sort by
that key inside the partitions (``repartition`` and ``sortWithinPartitions``,
the DataFrame form of ``repartitionAndSortWithinPartitions``) streams each
document's pieces in output order into an incremental digest. The same pass
looks for the marks in the streamed output, which tells prefix, middle and
suffix apart again, and gives the pieces their place in the original text; a
second sort inside the partitions, without a shuffle, streams them in that
order into the digest of the restored text.

Rows are numbered in scan order, so a row's pieces meet whatever its id, and
rows that share an id spread over all tasks. The numbers repeat when a lost
task runs again, as the order of a scanned table does; write other inputs
before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, table

CHUNK = 8192            # characters a piece
BATCH_CHARS = 4 << 20   # characters a batch sent on
PLAIN, PSM, SPM = "plain", "psm", "spm"
# The marks of prefix, suffix and middle, and the seed.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7

ORDER = {PSM: (PREFIX, SUFFIX, MIDDLE), SPM: (SUFFIX, PREFIX, MIDDLE)}
_RANK = {None: 0, PREFIX: 0, MIDDLE: 1, SUFFIX: 2}     # order in the original text
_HEAD = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint"
_PIECES = f"row bigint, at bigint, {_HEAD}, chunk string"
_ASSEMBLED = f"row bigint, place bigint, {_HEAD}, output_sha256 string, chunk string"
_DIGESTS = f"{_HEAD}, output_sha256 string, restored_sha256 string"
_TEXTS = f"{_HEAD}, output string"
_RESTORED = "doc_id bigint, text string"


@dataclass(frozen=True)
class Rates:
    """Percentages of documents that are transformed, and of these spm."""

    transformed: int = 100
    spm: int = 50


def n_units(text: str) -> int:
    return text.count("\n") + (text != "" and not text.endswith("\n"))


def _after_units(text: str, k: int) -> int:
    """Characters of the first ``k`` units."""
    at = 0
    for _ in range(k):
        at = text.find("\n", at) + 1
        if not at:
            return len(text)
    return at


def cut(doc_id: int | None, text: str, rates: Rates = Rates(), seed: int = SEED) -> tuple[int, str, int, int]:
    """(units, form, end of prefix, end of middle) of a document. The draw
    takes the decimal doc_id, the empty string for null."""
    n = n_units(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rates.transformed:
        return n, PLAIN, 0, 0
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    first = _after_units(text, a)
    return n, SPM if h4 % 100 < rates.spm else PSM, first, first + _after_units(text[first:], b - a)


def chunks(text: str, start: int, end: int, size: int = CHUNK) -> Iterator[str]:
    """``text[start:end]`` in runs of whole units of at most ``size``
    characters; a longer unit is cut."""
    while start < end:
        stop = min(start + size, end)
        if stop < end:
            stop = text.rfind("\n", start, stop) + 1 or stop
        yield text[start:stop]
        start = stop


class _Out:
    """Rows of one schema, given out in batches of bounded size."""

    def __init__(self, schema: str):
        kinds = {"bigint": pa.int64(), "string": pa.string()}
        self._types = [(n, kinds[t]) for n, t in (c.split() for c in schema.split(", "))]
        self._rows: list[tuple] = []
        self._chars = 0

    def add(self, *row) -> None:
        self._rows.append(row)
        self._chars += len(row[-1] or "") + 64

    def full(self) -> bool:
        return self._chars >= BATCH_CHARS

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self._rows, strict=True)) or [[] for _ in self._types]
        out = pa.record_batch([pa.array(c, t) for c, (_, t) in zip(columns, self._types, strict=True)],
                              names=[n for n, _ in self._types])
        self._rows, self._chars = [], 0
        return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _streamed(step: Callable[[tuple, _Out], None], schema: str, end: Callable[[_Out], None] | None = None):
    """A mapper's body: ``step`` per row, batches as they fill."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(schema)
        for row in _rows(batches):
            step(row, out)
            if out.full():
                yield out.batch()
        if end:
            end(out)
        yield out.batch()
    return run


def pieces(docs: DataFrame, rates: Rates = Rates(), seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """``(row, at, doc_id, n, form, prefix_chars, middle_chars, chunk)``, sorted
    by output position ``at`` within every row, all of a row in one partition.
    Position 0 holds what is known of the document, the others its pieces."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def step(row: tuple, out: _Out) -> None:
            number, doc_id, text = row
            n, form, first, second = cut(doc_id, text, rates, seed)
            plain = form == PLAIN
            out.add(number, 0, doc_id, n, form, None if plain else first, None if plain else second - first, None)
            spans = {PREFIX: (0, first), MIDDLE: (first, second), SUFFIX: (second, len(text))}
            at = 0
            for mark in (None,) if plain else ORDER[form]:
                if mark:
                    out.add(number, at := at + 1, *[None] * 5, mark)
                for part in chunks(text, *(spans[mark] if mark else (0, len(text))), chunk):
                    out.add(number, at := at + 1, *[None] * 5, part)

        return _streamed(step, _PIECES)(batches)

    numbered = id_text(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return numbered.mapInArrow(emit, _PIECES).repartition("row").sortWithinPartitions("row", "at")


class Splitter:
    """Tells the parts of a streamed output apart by the marks of its form.

    ``feed`` gives (mark, text) runs; a mark may lie across two chunks, so the
    end of what was fed is held back while marks are still to come."""

    def __init__(self, form: str):
        self._marks, self._mark, self._held = list(ORDER.get(form, ())), None, ""

    def feed(self, chunk: str) -> Iterator[tuple[str | None, str]]:
        data = self._held + chunk
        while self._marks and (at := data.find(self._marks[0])) >= 0:
            yield self._mark, data[:at]
            self._mark = self._marks.pop(0)
            data = data[at + len(self._mark):]
        keep = len(self._marks[0]) - 1 if self._marks else 0
        self._held = data[len(data) - keep:] if keep else ""
        yield self._mark, data[:len(data) - keep] if keep else data

    def end(self) -> tuple[str | None, str]:
        return self._mark, self._held


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams pieces in output order: the output's digest (place -1), and the
    pieces with their places in the original text."""
    doc: dict = {}

    def restore(runs: Iterator[tuple], out: _Out) -> None:
        for mark, text in runs:
            if text:
                doc["count"] += 1
                out.add(doc["row"], (_RANK[mark] << 40) + doc["count"], *[None] * 6, text)

    def finish(out: _Out) -> None:
        if doc:
            restore([doc["splitter"].end()], out)
            out.add(doc["row"], -1, *doc["head"], doc["digest"].hexdigest(), None)

    def step(row: tuple, out: _Out) -> None:
        number, at, *head, chunk = row
        if at == 0:
            finish(out)
            doc.update(row=number, head=head, digest=hashlib.sha256(), splitter=Splitter(head[2]), count=0)
            return
        doc["digest"].update(chunk.encode())
        restore(doc["splitter"].feed(chunk), out)

    return _streamed(step, _ASSEMBLED, finish)(batches)


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams pieces in their original order into the restored text's digest."""
    doc: dict = {}

    def finish(out: _Out) -> None:
        if doc:
            out.add(*doc["head"], doc["output"], doc["digest"].hexdigest())

    def step(row: tuple, out: _Out) -> None:
        _, place, *head, output, chunk = row
        if place == -1:
            finish(out)
            doc.update(head=head, output=output, digest=hashlib.sha256())
        else:
            doc["digest"].update(chunk.encode())

    return _streamed(step, _DIGESTS, finish)(batches)


def digests(pieces: DataFrame) -> DataFrame:
    """One row per document: ``(doc_id, n, form, prefix_chars, middle_chars,
    output_sha256, restored_sha256)``, from ``pieces`` as they are sorted."""
    assembled = pieces.mapInArrow(_assemble, _ASSEMBLED)
    # all rows of a document lie in its partition already
    return assembled.sortWithinPartitions("row", "place").mapInArrow(_restore, _DIGESTS)


def fill_in_middle(docs: DataFrame, rates: Rates = Rates(), seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """The transformed documents: ``(doc_id, n, form, prefix_chars,
    middle_chars, output)``, one row per row of ``docs (doc_id, text)``.

    A null text is the empty text, whose form is plain; a null ``doc_id`` stays
    null and draws with the empty string; repeated rows are transformed once
    each, all alike; other columns are ignored; an empty table gives no rows.
    Texts that hold a mark stay plain, so every output can be restored.
    """
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc: dict = {}

        def finish(out: _Out) -> None:
            if doc:
                out.add(*doc["head"], "".join(doc["parts"]))

        def step(row: tuple, out: _Out) -> None:
            _, at, *head, chunk = row
            if at == 0:
                finish(out)
                doc.update(head=head, parts=[])
            else:
                doc["parts"].append(chunk)

        return _streamed(step, _TEXTS, finish)(batches)

    return pieces(docs, rates, seed, chunk).mapInArrow(join, _TEXTS)


def restore(transformed: DataFrame) -> DataFrame:
    """``(doc_id, text)`` of transformed documents ``(doc_id, form, output)``."""
    def step(row: tuple, out: _Out) -> None:
        doc_id, form, output = row
        splitter = Splitter(form)
        parts: dict[int, list[str]] = {0: [], 1: [], 2: []}
        for mark, text in [*splitter.feed(output), splitter.end()]:
            parts[_RANK[mark]].append(text)
        out.add(doc_id, "".join(parts[0] + parts[1] + parts[2]))

    return transformed.select("doc_id", "form", "output").mapInArrow(_streamed(step, _RESTORED), _RESTORED)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``, transformed and restored."""
    return digests(pieces(table(spark, sf_dir, "documents")))


#: The same transformation of whole texts as string functions.
OP12_SQL = """
WITH d AS (SELECT doc_id, COALESCE(text, '') AS text,
                  sha256('7:' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS units,
             CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
             CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(units) AS n, LEAST(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a,
             GREATEST(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b FROM u),
p AS (SELECT doc_id, text, n,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                    OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
             array_to_string(list_slice(units, 1, a), '') AS prefix,
             array_to_string(list_slice(units, a + 1, b), '') AS middle,
             array_to_string(list_slice(units, b + 1, n), '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
