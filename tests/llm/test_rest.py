import hashlib
import random
import re

from pyspark.sql import functions as F

from folioloom.llm import chat, decontaminate, pii, url_lists

# ---- chat


def test_chat_round_trip_and_masks(spark):
    turns = [
        (1, 2, "assistant", "b <|im_end|>\n</s> &lt; & x"), (1, 1, "user", "a\nq"), (1, 3, "user", None), (2, 0, "system", ""), (3, 1, "user\n<x>", "[INST]"), (3, 2, "assistant", "one"),
        (3, 3, "assistant", "two"), (3, 3, "assistant", "two"), (None, 1, None, "lost"), (4, None, "assistant", "first"), (4, 1, "assistant", "é😀"),
    ]
    df = spark.createDataFrame([(*t, 9) for t in turns], "conv_id long, turn long, role string, text string, example int")
    records = chat.examples(df)
    rows = records.orderBy("conv_id", "example").collect()
    for r in rows:
        masked = r.formatted[r.loss_start : r.loss_end]
        assert r.loss_end == 0 or r.formatted[r.loss_end :] == chat.END
        assert "<|im_end|>" not in masked and "</s>" not in masked
    assert [r.example for r in rows if r.conv_id == 3] == [0, 1, 2]
    got = {r.conv_id: r for r in chat.digests(records).collect()}
    for conv in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        flat = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own)
        loss = "".join(t[3] or "" for t in own if t[2] == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(own), hashlib.sha256(flat.encode()).hexdigest())
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.examples(df.limit(0))).count() == 0


# ---- personal data

SIMPLE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(SIMPLE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and luhn, "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_base_spans_match_brute_force(spark):
    r = random.Random(3)
    rows = [(i, "".join(r.choice("ab1234567890.@+-() %_é😀\n") for _ in range(r.randint(1, 160)))) for i in range(1500)]
    rows += [(2000, None), (2001, ""), (2002, "a." * 3000 + "a@b.c_d@e.f.g 4111111111111111 4111 1111 1111 1111x" + "1." * 3000), (2003, "999.1.1.1 0255.0.0.1 +12 (345) 678-9012")]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    for i, text in rows:
        want = plain_spans(text)
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (text, got[i].spans, want)
        assert got[i].n_email == want.count("email:") and got[i].n_card == want.count("card:")


def test_disclosing_terms_are_added_and_replaced(spark):
    rows = [(i, f"w{chr(97 + i) * 4} q{chr(98 + i) * 5} write to anna@corp.example via Hildegard now please {chr(99 + i) * 6}") for i in range(8)]
    rows += [(100 + i, f"plain text now please write to somebody via mail {i}") for i in range(60)] + [(None, None), (3, "anna@corp.example x"), (3, "anna@corp.example x")]
    out = pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).withColumn("doc_id", F.col("row.doc_id"))
    got = {(r.doc_id, r.text): r.clean for r in out.withColumn("clean", pii.redact()).collect()}
    assert len(got) == len(rows) - 1 and out.count() == len(rows)
    clean = got[rows[0]]
    assert "[EMAIL]" in clean and "Hildegard" not in clean and "now please" in clean
    assert got[rows[20]] == rows[20][1]
    assert pii.personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_terms_far_from_the_value_are_counted_and_replaced_everywhere(spark):
    filler = lambda i: " ".join(f"{chr(97 + i)}{chr(97 + k)}filler" for k in range(26))
    rows = [(i, f"Hildegard {filler(i)} ann@corp.example {filler(i)} hildegard once more. Hildegard") for i in range(8)]
    rows += [(50, "ann@corp.example alone"), (60, "Hildegard is named without the value")] + [(100 + i, f"plain text {filler(i)}") for i in range(20)] * 4
    out = pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).withColumn("doc_id", F.col("row.doc_id")).withColumn("clean", pii.redact())
    got = {r.doc_id: r for r in out.collect()}
    assert all("hildegard" not in got[i].clean.lower() and "once more" not in got[i].clean for i in range(8))
    assert got[60].clean == rows[9][1]
    assert [(s.start, s.end) for s in got[0].spans if s.value == "hildegard"] == [m.span() for m in re.finditer("hildegard", rows[0][1], re.I)]


def test_copies_do_not_lower_disclosure(spark):
    texts = [f"Hildegard {w} ann@corp.example" for w in ("first", "second", "third")]
    rest = [(1000 + i, "plain first second third text") for i in range(600)]
    for rows in (
        [(i, texts[i % 3]) for i in range(300)],  # copies under other ids
        [(i % 3, texts[i % 3]) for i in range(300)],  # equal rows
        [(i, texts[0]) for i in range(100)],  # one text only
    ):
        out = pii.find_spans(spark.createDataFrame(rows + rest, "doc_id long, text string"), ["doc_id"]).withColumn("doc_id", F.col("row.doc_id"))
        got = [{s.value: s.kind for s in r.spans} for r in out.where("doc_id < 1000").collect()]
        assert len(got) == len(rows) and all(s.get("hildegard") == "removed" and "first" not in s for s in got)
        assert out.where("doc_id >= 1000 AND size(spans) > 0").count() == 0


# ---- decontamination


def plain_pairs(docs, items, share=0.8):
    out = set()
    for i, text in docs:
        words = re.findall(r"\w+", (text or "").lower())
        for j, item in items:
            q = re.findall(r"\w+", (item or "").lower())
            k = min(5, len(q))
            wanted = {tuple(q[x : x + k]) for x in range(len(q) - k + 1)} if k else set()
            shared = len(wanted & {tuple(words[x : x + k]) for x in range(len(words) - k + 1)})
            if wanted and shared >= share * len(wanted) - 1e-9:
                out.add((i, j, shared, len(wanted)))
    return out


def test_containment_both_ways(spark):
    r = random.Random(2)
    words = lambda n: [f"w{r.randint(0, 400)}" for _ in range(n)]
    items = [(j, " ".join(words(r.randint(1, 60)))) for j in range(40)] + [(100, None), (101, " ,, ")]
    docs = []
    for i in range(120):
        text = words(r.randint(0, 300))
        if i % 2:
            part = items[i % 40][1].split()
            for _ in range(r.randint(0, 3)):
                part[r.randrange(len(part))] = "zz"
            text[5:5] = part
        docs.append((i, " ".join(text).upper()))
    docs += [(500, None), (7, docs[7][1])]
    d, b = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")
    want = plain_pairs(docs, items)
    for limit in (decontaminate.MAX_BROADCAST_CHARS, 0):
        got = [tuple(x) for x in decontaminate.contaminated(d, b, max_chars=limit).collect()]
        assert set(got) == want and len(got) == len(want) + sum(p[0] == 7 for p in want)
        kept = {x.doc_id for x in decontaminate.clean(d, b, max_chars=limit).collect()}
        assert kept == {x[0] for x in docs} - {p[0] for p in want}
    assert decontaminate.contaminated(d.limit(0), b).count() == 0 and decontaminate.contaminated(d, b.limit(0)).count() == 0


def test_repeated_items_both_ways(spark):
    d = spark.createDataFrame([(1, "x one two three four five six seven y"), (2, "nothing here")], "doc_id long, text string")
    b = spark.createDataFrame([(5, "one two three four five six seven"), (5, "one two three four five six seven"), (6, "two three four five six")], "item_id long, text string")
    for limit in (decontaminate.MAX_BROADCAST_CHARS, 0):
        got = sorted(tuple(x) for x in decontaminate.contaminated(d, b, max_chars=limit).collect())
        assert got == [(1, 5, 3, 3), (1, 5, 3, 3), (1, 6, 1, 1)]


# ---- URL lists


def test_lists_as_of_the_fetch(spark):
    listed = [("bad", "Evil.example", "add", "2024-01-01"), ("bad", "evil.example", "remove", "2024-02-01"), ("ads", "x.org/ads/", "add", "2024-01-15"), ("bad", "both.net", "add", "2024-03-01"), ("bad", "both.net", "remove", "2024-03-01"), (None, "z.com", "add", "2024-01-01")]
    entries = spark.createDataFrame(listed, "list string, key string, action string, at string").withColumn("at", F.to_timestamp("at"))
    urls = [
        (1, "http://sub.EVIL.example:80/a", "2024-01-01", "bad:evil.example"), (2, "http://evil.example", "2023-12-31", ""), (3, "http://evil.example", "2024-02-01", ""), (4, "https://u@x.org/ads/y?z", "2024-02-01", "ads:x.org/ads"),
        (5, "https://x.org/adsy", "2024-02-01", ""), (6, "http://both.net.", "2024-04-01", "bad:both.net"), (7, None, "2024-04-01", ""), (8, "no url", "2024-04-01", ""), (8, "no url", "2024-04-01", ""), (9, "http://notevil.example/", "2024-01-05", ""), (10, "http://evil.example", None, ""),
    ]
    captures = spark.createDataFrame([(i, u, t, "k") for i, u, t, _ in urls], "page_id long, url string, t string, matched string").withColumn("fetched_at", F.to_timestamp("t"))
    got = sorted((r.page_id, r.blocked, r.matched) for r in url_lists.judge(captures, entries).collect())
    assert got == sorted((i, bool(m), m) for i, _, _, m in urls)
    assert url_lists.judge(captures.limit(0), entries).count() == 0


def test_pipeline_against_its_operators(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(8)
    words = lambda n: [f"{r.choice('bdfgk')}{r.choice('aeiou')}{r.choice('lmnr')}{r.randint(0, 60)}" for _ in range(n)]
    item = " ".join(words(20))
    rows = [(i, " ".join(words(60) + (["vilest", "grubber"] if i % 7 == 0 else []))) for i in range(210)]
    rows += [(300, rows[1][1]), (301, "start " + item + " end " + " ".join(words(30))), (302, " ".join(words(40)) + " reach me at jo@mail.example"), (303, None), (304, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i in range(210)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {x.doc_id: x for x in now.collect()}
        now = stage(spark, now, str(tmp_path)).cache()
        kept = {x.doc_id for x in now.collect()}
        if name == "toxicity":
            assert sum(i % 7 == 0 for i in kept if i < 210) <= 2 and sum(i % 7 != 0 for i in kept if i < 210) >= 178
        if name == "near_dedup":
            assert 300 not in kept and len({303, 304} & kept) == 1 and kept <= set(before)
        if name == "decontamination":
            assert set(before) - kept == {301}
        if name == "pii":
            assert "[EMAIL]" in now.where("doc_id = 302").first().text and kept == set(before)
        if name != "bpe":
            assert now.columns == docs.columns
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert {x.doc_id for x in final.collect()} == kept and final.where("doc_id = 302").first().n_tokens > 40
