"""Fill-in-middle transformation by secondary sort.

Every text is cut into chunks of code points, keyed by document and by the place that the chunk
takes in the output. repartitionAndSortWithinPartitions brings the chunks of a document together
in output order, so that one pass streams them into digests without building the output; the same
pass reads the output's marks back and sorts the chunks anew into the order of the text.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text

PREFIX, SUFFIX, MIDDLE = MARKS = "<P>", "<S>", "<M>"
#: The sections of an output, and the order in which a text has them.
FORMS = {"psm": "PSM", "spm": "SPM"}
IN_TEXT = {"T": 0, "P": 0, "M": 1, "S": 2}
#: Bytes of text that one partition is meant to get.
PART = 64_000_000
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def plan(doc_id: int | None, text: str, salt: str = "1:", plain_from: int = 90, spm_below: int = 20) -> tuple[str, int, int]:
    """(form, end of the prefix, end of the middle) of a text, by the hash of its id; a null id adds nothing to the salt."""
    n = len(text)
    h = hashlib.sha256(f"{salt}{'' if doc_id is None else doc_id}".encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(h[i:i + 4]) for i in range(0, 16, 4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not n or h3 % 100 >= plain_from or any(m in text for m in MARKS):
        return "plain", 0, n
    return "spm" if h4 % 100 < spm_below else "psm", a, b


def sections(text: str, form: str, a: int, b: int):
    """The parts of the output in order: marks and sections."""
    if form == "plain":
        yield text
        return
    part = {"P": text[:a], "M": text[a:b], "S": text[b:]}
    for k in FORMS[form]:
        yield f"<{k}>"
        yield part[k]


def _pieces(chunk: int, salt: str, plain_from: int, spm_below: int):
    """Rows of texts as ((document, place), piece). The piece at place -1 is the document's plan with its number of copies.

    A document is its id and text; equal rows of one partition send their chunks once and are counted.
    """

    def run(rows):
        again: dict[bytes, tuple] = {}
        for doc_id, text in rows:
            text = text or ""
            raw = text.encode()
            own = hashlib.blake2b(raw, digest_size=16, key=b"" if doc_id is None else str(doc_id).encode()).digest()
            if own in again:
                again[own] = (*again[own][:-1], again[own][-1] + 1)
                continue
            form, a, b = plan(doc_id, text, salt, plain_from, spm_below)
            again[own] = (doc_id, len(text), form, a, b - a, 1)
            place = 0
            for part in sections(text, form, a, b):
                for i in range(0, len(part), chunk):
                    piece = part[i:i + chunk]
                    yield (own, place), zlib.compress(piece.encode(), 1)
                    place += len(piece)
        for own, head in again.items():
            yield (own, -1), head

    return run


def _assembled(rows):
    """Sorted pieces as a row for each document: digests of the output, and of the text rebuilt from it, and the output's pieces."""
    for _, pieces in groupby(rows, key=lambda r: r[0][0]):
        head, copies, at, section = None, 0, -1, "T"
        out, back, held = hashlib.sha256(), hashlib.sha256(), []
        for (_, place), piece in pieces:
            if place < 0:
                head, copies = piece, copies + piece[-1]
                continue
            if place == at:  # the same chunk from another partition
                continue
            at, raw = place, zlib.decompress(piece)
            out.update(raw)
            if head[2] != "plain" and len(raw) == 3 and raw.decode() in MARKS:
                section = chr(raw[1])
            else:
                held.append((IN_TEXT[section], place, piece))
        for *_, piece in sorted(held, key=lambda p: p[:2]):
            back.update(zlib.decompress(piece))
        doc_id, n, form, before, middle, _ = head
        if form == "plain":
            before = middle = None
        yield from [(doc_id, n, form, before, middle, out.hexdigest(), back.hexdigest())] * copies


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = 16_384, salt: str = "1:", plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """Per row: its form, the lengths of its prefix and middle (null where plain), and the digests of its output and of the text rebuilt from that output.

    The number of partitions follows the size of the texts. A task holds one document's compressed
    chunks at most, however long; equal rows of a partition travel once, so repeated rows burden no task. Null and empty texts are plain and
    have the digest of nothing. Rows with null or repeated ids are rows of their own. An empty
    table gives an empty one; other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    source = id_and_text(docs, id_col, text_col)
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART))
    rows = source.rdd.mapPartitions(_pieces(chunk, salt, plain_from, spm_below))
    dealt = rows.repartitionAndSortWithinPartitions(parts, lambda k: int.from_bytes(k[0][:8]))
    return spark.createDataFrame(dealt.mapPartitions(_assembled), SCHEMA, verifySchema=False)


def outputs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salt: str = "1:", plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """(doc_id, form, output): the transformed texts themselves, row by row and without a shuffle."""

    @F.udf("form string, output string")
    def made(doc_id, text):
        form, a, b = plan(doc_id, text, salt, plain_from, spm_below)
        return form, "".join(sections(text, form, a, b))

    rows = id_and_text(docs, id_col, text_col)
    return rows.select("doc_id", made("doc_id", F.coalesce("text", F.lit(""))).alias("x")).select("doc_id", "x.*")


def restored(output: Column, form: Column) -> Column:
    """The text of which output was made."""
    parts = F.split(output, "<[PSM]>")
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
