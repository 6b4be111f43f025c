import random
import unicodedata

from pyspark.sql import functions as F

from burstlake.llm import visual as V


def reference(s):
    return unicodedata.normalize("NFC", "".join(V.LOOK_ALIKE.get(c, c) for c in unicodedata.normalize("NFD", s)))


def test_marks_and_look_alikes_against_unicodedata():
    r, pool = random.Random(5), "abcdeéèüñçAO ̧̣́̀̈̆ΩäийЁёοΑ"
    for _ in range(2000):
        texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 14))) for _ in range(r.randint(1, 6))]
        assert V.former().form(texts) == [reference(t) for t in texts]


def test_same_look():
    f = V.form_text
    assert f("ａｂｃ　１２") == "abc 12"
    assert f("a​b⁠c﻿­") == "abc"
    assert f("a b c d") == "a b c d"
    assert f("µΩK") == f("μΩK")
    assert f("раре") == "pape"
    assert f("각") == f("각")


def test_kept_apart():
    f = V.form_text
    for a, b in (("é", "e"), ("A", "a"), ("0", "O"), ("1", "l"), ("m²", "m2"), ("a–b", "a-b"), ("a—b", "a–b"), ('\\"o', "ö"), ("a\tb", "a b")):
        assert f(a) != f(b)


def test_idempotent_and_null_and_long():
    t = "é" * 300_000 + "ｘ" * 300_000
    once = V.form_text(t)
    assert once == "é" * 300_000 + "x" * 300_000 and V.form_text(once) == once
    assert V.form_text(None) is None and V.form_text("") == ""
    assert V.form_text("́a") == "́a"  # a mark without a base stays


def test_one_form_keeps_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "ａ", "y"), (3, "", "z")], "doc_id bigint, text string, text_form string")
    got = V.one_form(df).orderBy("doc_id").collect()
    assert [r.text_form for r in got] == [None, "a", ""] and got[1].text == "ａ"
    assert V.one_form(df.limit(0)).count() == 0
    assert [r.text for r in V.one_form(df, "text", "text").orderBy("doc_id").collect()] == [None, "a", ""]


def brute(rows):
    out = set()
    for i, s in rows:
        for j, t in rows:
            if s is not None and t is not None and i < j and s != t and V.form_text(s) == V.form_text(t):
                out.add((i, j))
    return out


def test_pairs_against_brute_force(spark):
    r = random.Random(2)
    forms = ["abc", "ａbc", "аbc", "ab​c", "abd", "", "​", "é", "é", None]
    for key in ("doc_id", "look", "stored"):
        rows = [(k, r.choice(forms)) for k in range(60)]
        df = spark.createDataFrame(rows, f"{key} bigint, text string")
        assert {tuple(x) for x in V.look_pairs(df, key).collect()} == brute(rows)
    assert V.look_pairs(df.limit(0), key).count() == 0


def test_classes_and_repeated_rows(spark):
    rows = [(1, "a"), (2, "а"), (2, "а"), (3, "b"), (4, None)]
    got = {tuple(x) for x in V.look_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).distinct().collect()}
    assert got == {(1, 1, 3, 2), (2, 1, 3, 2), (3, 3, 1, 1)}


def test_hot_class_is_salted(spark):
    from burstlake.operators.skew import salted_join

    big = spark.range(5000).select((F.col("id") % 3 * F.col("id")).alias("k"), "id")
    small = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = salted_join(big, small, ["k"], spread="id", floor=10)
    assert got.count() == big.join(small, "k").count() and got.where("v <> 2 * k").count() == 0
    left = salted_join(big.withColumn("k", F.when(F.col("k") > 0, F.col("k"))), small, ["k"], spread="id", how="left", floor=10)
    assert left.count() == 5000


def test_rare_look_alikes():
    f = V.form_text
    assert f("ⅠⅤⅩⅬⅭⅮⅯ ⅰⅴⅹⅼⅽⅾⅿ") == "IVXLCDM ivxlcdm"
    assert f("օսհ ՕՍ") == "ouh OU" and f("Ӏӏ") == "Il" and f("ᎠᎡᎢᎪ") == "DRTA" and f("ꓐꓑꓓꓔ") == "BPDT"
    for a, b in (("Ӏ", "l"), ("Ӏ", "1"), ("ⅼ", "1"), ("ⅼ", "I"), ("Ꮞ", "4"), ("Օ", "0"), ("Ⅴ", "ⅴ")):
        assert f(a) != f(b)
    script = lambda c: unicodedata.name(c).split()[0]
    both = V.LOOK_ALIKE | V.RARE_ALIKE
    seen = [(script(c), x) for c, x in both.items() if c not in "‐‑Ӏ"]
    assert len(both) == len(V.LOOK_ALIKE) + len(V.RARE_ALIKE) and len(seen) == len(set(seen))


def test_published_look_alikes(spark):
    """Every letter of the published data comes out as its ASCII letter, and no two letters of a script as one."""
    import unicodedata

    from burstlake.llm import visual as V

    alike = V.published(spark)
    f = V.former(V.tables(alike))
    assert len(alike) > 100 and f.form([a for a, _ in alike]) == [b for _, b in alike]
    assert f.form(["α", "ρ", "υ", "ⲟ", "ᗷ", "σ", "ß", "é", "ı"]) == ["a", "p", "u", "o", "B", "σ", "ß", "é", "ı"]
    seen = set()
    for a, b in alike + tuple(V.LOOK_ALIKE.items()):
        if a.isalpha() and unicodedata.name(a).split()[0] != "CYRILLIC":
            assert (key := (unicodedata.name(a).split()[0], b)) not in seen
            seen.add(key)
