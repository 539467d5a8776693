import hashlib
import random
import re

from parvis.llm import fill_in_middle as fim
from parvis.llm import queries


def by_hand(doc_id, text, fim_percent=100, spm_percent=50):
    """The output put together from slices."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    if doc_id is None or not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    digest = hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    if h3 % 100 >= fim_percent:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < spm_percent:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def documents():
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab é\U0001f600\n<>PSM") for _ in range(rng.randint(0, 200))) for _ in range(300)]
    texts += [None, "", "\n", "\n\n\n", "one line", "a\r\nb c\x0bd\n", "has <M> in it\n" * 3, "<P", "x\n" * 5, "x\n" * 5]
    texts += [("long line é " * 9000 + "\n") * 3 + "end", "<S\n>\n<\n" * 40000]
    return list(enumerate(texts)) + [(None, "no id\nat all\n"), (3, texts[3])]


def test_same_as_slices_and_restored(spark):
    rows = documents()
    table = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, n int, output string").repartition(3)
    for percents in ((100, 50), (60, 100), (0, 0)):
        made = fim.fill_in_middle(table, fim_percent=percents[0], spm_percent=percents[1])
        assert made.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
        got = made.withColumn("back", fim.restored(made.output, made.form)).collect()
        want = sorted((i, *by_hand(i, t, *percents)) for i, t in rows if i is not None)
        assert sorted((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got if r.doc_id is not None) == want
        assert all(r.back == (r.text or "") for r in got) and len(got) == len(rows)
        assert [r.form for r in got if r.doc_id is None] == ["plain"]
    assert fim.fill_in_middle(table.limit(0)).collect() == []


def test_both_forms_occur_and_digests(spark, tmp_path):
    rows = [r for r in documents() if r[0] is not None]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_fill_in_middle(spark, str(tmp_path)).collect()
    assert {r.form for r in got} == {"plain", "spm", "psm"}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted((*(made := (i, *by_hand(i, t)))[:5], sha(made[5]), sha(t or "")) for i, t in rows)
    assert sorted((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in got) == want


def test_rotation_with_small_blocks(monkeypatch):
    monkeypatch.setattr(fim, "BLOCK", 3)
    rng = random.Random(0)
    for _ in range(300):
        data = bytearray(rng.randbytes(rng.randint(0, 40)))
        low, cut, high = sorted(rng.randint(0, len(data)) for _ in range(3))
        want = data[:low] + data[cut:high] + data[low:cut] + data[high:]
        fim.rotate(data, low, cut, high)
        assert data == want
