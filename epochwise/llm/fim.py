"""Fill-in-middle transformation put together by a secondary sort.

Every text is cut into pieces of at most CHUNK code points, keyed by document and by their position in the output.  One
shuffle brings the pieces of a document together and sorts them by that position; they run one after the other through an
incremental digest.  The reader knows no cut positions: it finds the parts by the marks in the stream, and gives every
piece its place in the source.  A second sort inside the partition, by that place, streams the pieces through the digest of
the restored text.  No task holds more than a batch of pieces; both sorts spill.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from epochwise.llm.base import Batches, arrow_rows, query, slim, table, total_bytes

#: Fixed values of the format.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percentages: texts left plain; of the others, those that begin with the suffix.
PLAIN_SHARE, SPM_SHARE = 10, 20
#: Code points of a piece; bytes of text a partition should hold; partitions at most (they are sorted with spilling).
CHUNK, PART_BYTES, MOST_PARTS = 1 << 14, 16 << 20, 1 << 16
#: Place of a part in the source, by its mark.
_PLACE = {PREFIX.encode(): 0, MIDDLE.encode(): 1, SUFFIX.encode(): 2}
_KEY = "salt int, doc_id long, mark binary"
_PIECES = f"{_KEY}, form string, times long, at long, piece binary"
_MOVED = f"{_KEY}, part int, at long, form string, times long, lengths array<long>, digest string, piece binary"


def cuts(doc_id: int | None, text: str) -> tuple[str, int, int]:
    """(form, end of the prefix, end of the middle); a null id counts as an empty one."""
    n = len(text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    if not n or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= 100 - PLAIN_SHARE:
        return "plain", n, n
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return ("spm" if h4 % 100 < SPM_SHARE else "psm"), a, b


def arranged(doc_id: int | None, text: str) -> tuple[str, list[str | tuple[int, int]]]:
    """The form, and the output as marks and (start, end) ranges of the text."""
    form, a, b = cuts(doc_id, text)
    n = len(text)
    if form == "plain":
        return form, [(0, n)]
    if form == "psm":
        return form, [PREFIX, (0, a), SUFFIX, (b, n), MIDDLE, (a, b)]
    return form, [SUFFIX, (b, n), PREFIX, (0, a), MIDDLE, (a, b)]


def restored(output: str, form: str) -> str:
    """The text that an output was made of; no mark can begin inside a part, so the first one found is the right one."""
    if form == "plain":
        return output
    first, rest = output[3:].split(SUFFIX if form == "psm" else PREFIX, 1)
    second, middle = rest.split(MIDDLE, 1)
    return first + middle + second if form == "psm" else second + middle + first


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of every text.  Repeated rows of one batch travel once, with their number; the partition is part of the key,
    so a row that makes up a third of the table is spread as its copies are."""
    out, salt = Batches(_PIECES), TaskContext.get().partitionId()
    for batch in batches:
        seen: dict[tuple, int] = {}
        for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            key = (row[0], row[1] or "")
            seen[key] = seen.get(key, 0) + 1
        for (doc_id, text), times in seen.items():
            mark = hashlib.blake2b(text.encode(), digest_size=16).digest()
            form, parts = arranged(doc_id, text)
            at = 0
            for part in parts:
                if isinstance(part, str):
                    chunks = [part]
                else:
                    start, end = part
                    chunks = (text[i : min(i + CHUNK, end)] for i in range(start, end, CHUNK))
                for piece in chunks if text else [""]:
                    if out.add(salt, doc_id, mark, form, times, at, piece.encode()):
                        yield out.take()
                    at += len(piece)
    yield out.take()


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces come sorted by output position: digest of the output, and every piece with its place in the source.

    The last row of a document is its head (part -1): lengths of prefix, middle and suffix, digest, number of rows.
    """
    out = Batches(_MOVED)
    for key, group in groupby(arrow_rows(batches), itemgetter(0, 1, 2)):
        digest, part, lengths, copies, last, form = hashlib.sha256(), 0, [0, 0, 0], 0, -1, None
        for *_, form, times, at, piece in group:
            copies += times if at == 0 else 0
            if at == last:  # the same row from another batch
                continue
            last = at
            digest.update(piece)
            if form != "plain" and piece in _PLACE:
                part = _PLACE[piece]
                continue
            if out.add(*key, part, lengths[part], None, None, None, None, piece):
                yield out.take()
            lengths[part] += len(piece.decode())
        if out.add(*key, -1, 0, form, copies, lengths, digest.hexdigest(), None):
            yield out.take()
    yield out.take()


def _restore(texts: bool, ddl: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces come sorted by place in the source, the head first."""
        out = Batches(ddl)
        for key, group in groupby(arrow_rows(batches), itemgetter(0, 1, 2)):
            *_, form, copies, lengths, sha, _ = next(group)
            digest, held = hashlib.sha256(), []
            for *_, piece in group:
                digest.update(piece)
                if texts:
                    held.append(piece)
            plain = form == "plain"
            row = [key[1], sum(lengths), form, None if plain else lengths[0], None if plain else lengths[1], sha, digest.hexdigest()]
            if texts:
                whole = b"".join(held).decode()
                p, m, _ = lengths
                a, b, c = whole[:p], whole[p : p + m], whole[p + m :]
                row.append(whole if plain else f"{PREFIX}{a}{SUFFIX}{c}{MIDDLE}{b}" if form == "psm" else f"{SUFFIX}{c}{PREFIX}{a}{MIDDLE}{b}")
            for _ in range(copies):
                if out.add(*row):
                    yield out.take()
        yield out.take()

    return run


def transformed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256, output), a row per input row.

    Null and empty texts are plain with n = 0; plain rows have null cuts.  A null id is hashed as an empty one and stays null.
    Repeated rows keep a row each; rows that share an id but not the text are cut each by its own length.  Without ``texts``
    the outputs are not returned and no task holds a whole one.
    """
    rows = slim(docs, id_col, text_col)
    parts = min(MOST_PARTS, max(1, -(-total_bytes(rows) // PART_BYTES)))
    pieces = rows.mapInArrow(_emit, _PIECES).repartition(parts, "salt", "doc_id", "mark")
    moved = pieces.sortWithinPartitions("salt", "doc_id", "mark", "at").mapInArrow(_assemble, _MOVED)
    ddl = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    ddl += ", output string" if texts else ""
    return moved.sortWithinPartitions("salt", "doc_id", "mark", "part", "at").mapInArrow(_restore(texts, ddl), ddl)


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n,
                  sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
c AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS y,
      CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90
           THEN 'plain' WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, substr(t, 1, least(x, y)) AS pre, substr(t, least(x, y) + 1, greatest(x, y) - least(x, y)) AS mid,
             substr(t, greatest(x, y) + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(x, y) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN greatest(x, y) - least(x, y) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


@query("op11_fim", ORACLE)
def op11_fim(spark, sf_dir):
    return transformed(table(spark, sf_dir, "documents"), texts=False)
