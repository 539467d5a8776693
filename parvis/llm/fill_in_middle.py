"""Fill-in-middle documents: whole lines cut into prefix, middle and suffix, rearranged in place.

The text lies in one bytearray. Sentinels are inserted before their blocks, and
neighbouring blocks change places by a rotation made of three reversals, each with
a buffer of fixed size. The way back inverts the rotation and takes the sentinels out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
BLOCK = 1 << 16  # bytes a reversal copies at a time
ARRANGED = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def reverse(view, low: int, high: int) -> None:
    """Bytes ``low`` to ``high`` of a numpy view in reverse order, from both ends inwards."""
    while high - low > 1:
        step = min(BLOCK, (high - low) // 2)
        left = view[low : low + step].copy()
        view[low : low + step] = view[high - step : high][::-1]
        view[high - step : high] = left[::-1]
        low, high = low + step, high - step


def rotate(buffer: bytearray, low: int, cut: int, high: int) -> None:
    """The blocks [low, cut) and [cut, high) change places."""
    import numpy as np

    view = np.frombuffer(buffer, np.uint8)
    reverse(view, low, cut)
    reverse(view, cut, high)
    reverse(view, low, high)


def line_ends(buffer: bytearray) -> list[int]:
    """Where each line ends; a line keeps its newline, and a last one without it counts."""
    import numpy as np

    ends = (np.flatnonzero(np.frombuffer(buffer, np.uint8) == 10) + 1).tolist()
    return ends if not buffer or buffer.endswith(b"\n") else [*ends, len(buffer)]


def code_points(buffer: bytearray, low: int, high: int) -> int:
    import numpy as np

    return int(np.count_nonzero((np.frombuffer(buffer, np.uint8)[low:high] & 0xC0) != 0x80))


def arrange(text: str, digest: str | None, fim_percent: int, spm_percent: int) -> tuple[int, str, int | None, int | None, str]:
    """(lines, form, code points of prefix and of middle, output) of one text."""
    buffer = bytearray(text, "utf-8")
    ends = line_ends(buffer)
    n = len(ends)
    if not n or digest is None or any(m in buffer for m in MARKS):
        return n, "plain", None, None, text
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if h3 % 100 >= fim_percent:
        return n, "plain", None, None, text
    one, two = (ends[k - 1] if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    counts = code_points(buffer, 0, one), code_points(buffer, one, two)
    prefix, suffix, middle = MARKS
    for at, mark in ((two, suffix), (one, middle), (0, prefix)):
        buffer[at:at] = mark
    one, two = one + len(prefix), two + len(prefix) + len(middle)
    spm = h4 % 100 < spm_percent
    rotate(buffer, 0 if spm else one, two, len(buffer))
    return n, "spm" if spm else "psm", *counts, buffer.decode()


def rebuild(output: str, form: str) -> str:
    """The text an output was made of."""
    if form == "plain":
        return output
    buffer = bytearray(output, "utf-8")
    prefix, suffix, middle = MARKS
    one, two = (buffer.index(prefix), len(buffer)) if form == "spm" else (buffer.index(suffix), buffer.index(middle))
    if form == "spm":
        rotate(buffer, 0, one, two)
    else:
        rotate(buffer, one, two, len(buffer))
    for mark in (suffix, middle, prefix):
        at = buffer.index(mark)
        del buffer[at : at + len(mark)]
    return buffer.decode()


def arranged(text: Column, digest: Column, fim_percent: int = 100, spm_percent: int = 50) -> Column:
    """A struct of the lines of ``text``, its form, the sizes of prefix and middle and the output."""
    import pyarrow as pa

    def apply(texts, digests):
        rows = [arrange(t.as_py(), d.as_py(), fim_percent, spm_percent) for t, d in zip(texts, digests)]
        names = ("n", "form", "prefix_chars", "middle_chars", "output")
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    apply.__annotations__ = {"texts": pa.Array, "digests": pa.Array, "return": pa.Array}
    return F.arrow_udf(apply, ARRANGED)(F.coalesce(text, F.lit("")), digest)


def restored(output: Column, form: Column) -> Column:
    """The text behind ``output``, from it and its form alone; null for a null output or form."""
    import pyarrow as pa

    def apply(outputs, forms):
        both = zip(outputs.to_pylist(), forms.to_pylist())
        return pa.array([None if o is None or f is None else rebuild(o, f) for o, f in both], pa.string())

    apply.__annotations__ = {"outputs": pa.Array, "forms": pa.Array, "return": pa.Array}
    return F.arrow_udf(apply, "string")(output, form)


def fill_in_middle(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 7, fim_percent: int = 100, spm_percent: int = 50
) -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars and output.

    Cuts and form are drawn from the SHA-256 of ``<seed>:<doc_id>``, so a row's result
    depends on nothing else: repeated rows come out alike, in any partitioning. Plain,
    that is unchanged, are a null (as an empty) or empty text, a text that holds a
    sentinel, a row without doc_id, and what ``fim_percent`` leaves out. Empty prefix,
    middle or suffix are possible. Columns of ``docs`` named like the new ones are replaced.
    """
    made = ("n", "form", "prefix_chars", "middle_chars", "output")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(doc_id).cast("string")).cast("binary"), 256)
    others = [F.col(c) for c in docs.columns if c not in made]
    rows = docs.select(*others, arranged(F.col(text), digest, fim_percent, spm_percent).alias("_arranged"))
    return rows.select(*[c for c in rows.columns if c != "_arranged"], "_arranged.*")


#: the contract of op13 in SQL, without rotations
SQL = """
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS lines,
         sha256('7:' || doc_id) AS h
  FROM documents
), drawn AS (
  SELECT *, len(lines) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(lines) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(lines) + 1) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM cut
), parts AS (
  SELECT doc_id, t, n, form,
         coalesce(array_to_string(lines[1:least(a, b)], ''), '') AS p,
         coalesce(array_to_string(lines[least(a, b) + 1:greatest(a, b)], ''), '') AS m,
         coalesce(array_to_string(lines[greatest(a, b) + 1:n], ''), '') AS s
  FROM drawn
)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
