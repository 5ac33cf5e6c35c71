"""Fill-in-middle: a text is cut in three at two unit ends and laid out anew around sentinels.

An Arrow-batched pandas UDF does it. The regex library's ``finditer`` goes through the text once, RUN units to a
match (the library keeps every capture of a repeated group, which is three times faster than a match a unit),
and the end of each unit goes to a compact array of four bytes a unit; two looked-up ends slice prefix,
middle and suffix.
SHA-256 of ``1:`` and the doc_id gives the seeds, so a row's cut depends on nothing but its id and text, and a
task that is run again gives the same.

With n units, prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) units and middle after the larger;
what follows the last unit (with a unit that doesn't cover the text) belongs to the suffix. A text stays plain
if it has no character, holds a sentinel, or h3 % 100 >= ``whole``; otherwise it is spm if h4 % 100 < ``spm``,
else psm. A null text is empty. A null doc_id is seeded as the word ``null``. Rows that repeat an id and text
get the same result each. An empty table gives no row. A text of any length is one step: it needs its own
size a few times and four bytes a unit. Nothing is shuffled; columns of other names are left out, or go along
if they are named in ``keep``.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waypath.llm.shared import end_task, small_batches

#: A unit is a code point; ``\\X`` takes grapheme clusters, ``\\S+\\s*`` words.
CODE_POINT = "(?s:.)"
RUN = 1024
#: The sentinels before prefix, suffix and middle.
P, S, M = "<P>", "<S>", "<M>"
#: Texts in a hundred that are cut, and of those how many begin with the suffix.
WHOLE, SPM = 90, 20

SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"


def seeds(doc_id: int | str | None) -> list[int]:
    """h1 to h4: the first four groups of eight hex digits of the id's SHA-256."""
    h = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in range(0, 32, 8)]


def runs_of(unit: str) -> regex.Pattern:
    """Matches of up to RUN units that follow each other, each a capture of group 1."""
    if regex.fullmatch(unit, ""):
        raise ValueError(f"a unit may not be empty: {unit!r}")
    return regex.compile(f"({unit}){{1,{RUN}}}+")


def ends(text: str, units: regex.Pattern) -> array:
    """Where each unit ends, in code points."""
    out = array("I")
    for run in units.finditer(text):
        out.extend(run.ends(1))
    return out


def cut(text: str, at: array, h: list[int], whole: int = WHOLE, spm: int = SPM) -> tuple[str, str, str, str]:
    """(form, prefix, middle, suffix) of a text with unit ends ``at``; a plain text is all prefix."""
    if not text or P in text or S in text or M in text or h[2] % 100 >= whole:
        return "plain", text, "", ""
    n = len(at) + 1
    a, b = sorted((h[0] % n, h[1] % n))
    a, b = (at[k - 1] if k else 0 for k in (a, b))
    return "spm" if h[3] % 100 < spm else "psm", text[:a], text[a:b], text[b:]


def laid_out(form: str, prefix: str, middle: str, suffix: str) -> str:
    if form == "psm":
        return f"{P}{prefix}{S}{suffix}{M}{middle}"
    return f"{S}{suffix}{P}{prefix}{M}{middle}" if form == "spm" else prefix


def restored(output: str, form: str) -> str:
    """The text that ``output`` was made of. No cut text holds a sentinel, so each is found where it was put."""
    if form == "plain":
        return output
    first, second = (P, S) if form == "psm" else (S, P)
    j, k = output.index(second), output.index(M)
    one, two, middle = output[len(first) : j], output[j + len(second) : k], output[k + len(M) :]
    return one + middle + two if form == "psm" else two + middle + one


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fill_in_middle(docs: DataFrame, *keep: str, unit: str = CODE_POINT, whole: int = WHOLE, spm: int = SPM) -> DataFrame:
    """doc_id, the columns ``keep`` and those of SCHEMA for every row of ``docs`` (doc_id, text)."""
    small_batches(docs.sparkSession)
    pattern = runs_of(unit)

    @F.pandas_udf(SCHEMA)
    def fim(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, texts in batches:
            out = []
            for doc_id, text in zip(ids, texts, strict=True):
                text = text if isinstance(text, str) else ""
                at = ends(text, pattern)
                form, prefix, middle, suffix = cut(text, at, seeds(doc_id if isinstance(doc_id, str) else None), whole, spm)
                output = laid_out(form, prefix, middle, suffix)
                chars = (None, None) if form == "plain" else (len(prefix), len(middle))
                out.append((len(at), form, *chars, output, _sha256(output), _sha256(restored(output, form))))
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            yield pd.DataFrame(out, columns=names).astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})
        end_task()

    # the id goes as text: a column of numbers with nulls would come as floats
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fim(F.col("doc_id").cast("long").cast("string"), F.col("text").cast("string")).alias("_fim"), *keep)
    return rows.select("doc_id", "_fim.*", *keep)


def digests(docs: DataFrame) -> DataFrame:
    """The rows of :func:`fill_in_middle` without the texts themselves."""
    return fill_in_middle(docs).drop("output")


SQL = f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents
), s AS (
  SELECT doc_id, text, n, CAST('0x' || substr(h, 1, 8) AS UBIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS UBIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS UBIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS UBIGINT) AS h4 FROM t
), c AS (
  SELECT *, CASE WHEN n = 0 OR contains(text, '{P}') OR contains(text, '{S}') OR contains(text, '{M}') OR h3 % 100 >= {WHOLE} THEN 'plain'
                 WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form,
         CAST(least(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS a, CAST(greatest(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS b FROM s
), x AS (
  SELECT *, substr(text, 1, a) AS pre, substr(text, a + 1, b - a) AS mid, substr(text, b + 1) AS suf FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{P}' || pre || '{S}' || suf || '{M}' || mid ELSE '{S}' || suf || '{P}' || pre || '{M}' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM x
"""
