"""Fill-in-middle transformation with cuts taken from one repeated-capture match.

A text is a run of units: blanks and the word after them, or the blanks at its
end.  One ``fullmatch`` of ``(unit)*`` keeps the end of every repetition, so
that ``ends(1)`` gives the number of units and both cut places at once.  Form
and cuts are functions of the document's id, so reruns agree on any
partitioning and nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 42
#: of 100 documents that can be cut, so many are; of 100 cut ones, so many put the suffix first
FIM_RATE, SPM_RATE = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
_UNITS = regex.compile(rf"({UNIT})*")
_WORD_END = regex.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D])")
#: code points matched at once: a match keeps some hundred bytes for each unit.  A longer text is
#: matched in slices that end at the end of a word, where a unit always ends
SLICE_CHARS = 1 << 20
#: output handed over at once
OUTPUT_CHARS = 4 << 20


def unit_ends(text: str, slice_chars: int = SLICE_CHARS) -> list[int]:
    """The end of each unit of a text, in code points."""
    if len(text) <= slice_chars:
        return _UNITS.fullmatch(text).ends(1)
    ends, at = [], 0
    while at < len(text):
        cut = _WORD_END.search(text, at + slice_chars)
        to = cut.end() if cut else len(text)
        ends += _UNITS.fullmatch(text, at, to).ends(1)
        at = to
    return ends


def draws(doc_id: str, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit draws of a document."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i:i + 4], "big") for i in range(0, 16, 4))


def transform(doc_id: str, text: str, seed: int = SEED, fim_rate: int = FIM_RATE,
              spm_rate: int = SPM_RATE) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    ends = unit_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= fim_rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[a - 1] if a else 0), (ends[b - 1] if b else 0)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_rate:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, seed: int = SEED, fim_rate: int = FIM_RATE, spm_rate: int = SPM_RATE,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output): every whole text in its training form.

    ``n`` counts units; lengths are in code points and null where the form is
    ``plain``.  Null texts count as empty and stay plain, as do texts that hold
    one of the marks.  A null id draws as the empty string; rows with equal id
    draw alike, each over its own text; repeated rows are transformed each; an
    empty table gives no rows.  Other columns have no part in it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)

        schema = None
        for batch in batches:
            schema = schema or pa.schema([
                ("id", batch.schema.field("id").type), ("n", pa.int64()), ("form", pa.string()),
                ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.large_string())])
            rows, size = [], 0
            for own, key, text in zip(batch.column("id"), batch.column("key"), batch.column("text")):
                rows.append((own.as_py(), *transform(key.as_py(), text.as_py(), seed, fim_rate, spm_rate)))
                size += len(rows[-1][-1])
                if size > OUTPUT_CHARS:
                    yield out(rows)
                    rows, size = [], 0
            if rows:
                yield out(rows)

    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return given.mapInArrow(run, f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, "
                            "output string").withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: the parts between its marks, put back in order."""
    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substring(output, F.lit(len(first) + 1), F.length(output))
        one = F.substring_index(rest, second, 1)
        tail = F.substring(rest, F.length(one) + len(second) + 1, F.length(rest))
        two = F.substring_index(tail, MIDDLE, 1)
        return one, two, F.substring(tail, F.length(two) + len(MIDDLE) + 1, F.length(tail))

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)


def digest(made: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n, form, prefix_chars, middle_chars and the checksums of the output and of the text rebuilt from it."""
    return made.select(id_col, "n", "form", "prefix_chars", "middle_chars",
                       F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def oracle_sql() -> str:
    """DuckDB SQL of :func:`digest` over ``documents``."""
    draw = ", ".join(f"('0x' || substr(h, {8 * i + 1}, 8))::bigint AS h{i + 1}" for i in range(4))
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(doc_id::varchar, '')) AS h,
                      regexp_extract_all(coalesce(text, ''), '{UNIT}') AS units FROM documents),
    x AS (SELECT doc_id, t, units, len(units) AS n, {draw} FROM d),
    c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                 CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}')
                           OR h3 % 100 >= {FIM_RATE} THEN 'plain'
                      WHEN h4 % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM x),
    p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle,
                 array_to_string(units[b + 1:], '') AS suffix FROM c)
    SELECT doc_id, n::bigint AS n, form,
           CASE WHEN form <> 'plain' THEN length(prefix) END::bigint AS prefix_chars,
           CASE WHEN form <> 'plain' THEN length(middle) END::bigint AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t
                            WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
                            ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256,
           sha256(CASE form WHEN 'plain' THEN t ELSE prefix || middle || suffix END) AS restored_sha256
    FROM p"""
