"""Fill-in-the-middle training texts: a document cut at two word boundaries and put in another order.

A text is cut into units (a word with the white space before it).  Two draws from the document's hash
choose the boundaries of prefix, middle and suffix, two more whether and in which order they are
written: prefix-suffix-middle (psm) or suffix-prefix-middle (spm), each part behind its mark.

Scale: a narrow Arrow-batched pandas UDF, no shuffle and no state.  The end offset of each unit goes into
a compact array of four bytes an entry, whatever the length of the text; the text is then sliced twice.
All draws come from a hash of seed and id, so a recomputed task writes the same text.

Defined results: a null text is the empty text, whose form is plain; texts that contain a mark stay plain,
so that a written text can be read back without doubt; a null id is drawn as the empty string; repeated
rows each give a row (rows with equal ids share their draws); texts are never cut; other columns pass
through, and one that clashes with ``name`` raises ValueError; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.llm.tables import quoted

SEED = 42
RATE = 50  # per cent of the documents that are rearranged
SPM_RATE = 80  # per cent of those that begin with the suffix
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = regex.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")

KIND = "struct<n: long, form: string, prefix_chars: long, middle_chars: long, output: string>"


def unit_ends(text: str) -> array:
    """Where each unit ends, in code points."""
    return array("I", (m.end() for m in UNIT.finditer(text)))


def draws(ident: str, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{ident}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4)]


def arranged(text: str, ident: str, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple:
    """(units, form, prefix length, middle length, written text); lengths are None where nothing moves."""
    ends = unit_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = draws(ident, seed)
    if not text or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = ends[low - 1] if low else 0, ends[high - 1] if high else 0
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_rate:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def read_back(output: str, form: str) -> str:
    """The text that ``output`` was written from."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    before, middle = output[len(first) :].split(MIDDLE)
    one, two = before.split(second)
    return two + middle + one if form == "spm" else one + middle + two


def fill_in_middle(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", name: str = "fim", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """``df`` with a struct ``name``: n, form, prefix_chars, middle_chars and the written text as output."""
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the input already has a column named {name}")

    @F.pandas_udf(KIND)
    def arrange(texts: pd.Series, idents: pd.Series) -> pd.DataFrame:
        made = [arranged(t, i, seed, rate, spm_rate) for t, i in zip(texts, idents)]
        n, form, prefix, middle, output = zip(*made) if made else ((),) * 5
        return pd.DataFrame(
            {"n": pd.Series(n, dtype="int64"), "form": pd.Series(form, dtype="object"), "prefix_chars": pd.array(prefix, dtype="Int64"), "middle_chars": pd.array(middle, dtype="Int64"), "output": pd.Series(output, dtype="object")}
        )

    text, ident = (F.coalesce(F.col(quoted(c)).cast("string"), F.lit("")) for c in (text_col, id_col))
    return df.select(*[F.col(quoted(c)) for c in df.columns], arrange(text, ident).alias(name))


def restored(output: Column, form: Column) -> Column:
    """The text behind a written one."""

    @F.pandas_udf("string")
    def back(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([read_back(o, f) for o, f in zip(outputs, forms)], dtype="object")

    return back(output, form)


def sha256(text: Column) -> Column:
    """Lowercase hex digest of a text's UTF-8 bytes."""

    @F.pandas_udf("string")
    def digest(texts: pd.Series) -> pd.Series:
        return pd.Series([hashlib.sha256(t.encode()).hexdigest() for t in texts], dtype="object")

    return digest(text)


def document_fim(docs: DataFrame) -> DataFrame:
    """Form, lengths and digests of every document's written text and of the text read back from it."""
    made = fill_in_middle(docs.select("doc_id", "text"), name="fim")
    return made.select(
        "doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", sha256(F.col("fim.output")).alias("output_sha256"), sha256(restored(F.col("fim.output"), F.col("fim.form"))).alias("restored_sha256")
    )


FIM_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents),
k AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM k),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
