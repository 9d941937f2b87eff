"""Each operator against brute force on small tables with nulls, ties, repeats and clashing columns."""

import hashlib
import json
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_tables import DOCS, edit_distance, survivor, table

from chronofold.llm import chat, decontaminate, kernels, language, line_dedup, mixing, near_dup, pii, simhash, suffixes, toxicity

WORDS = [f"w{i}" for i in range(60)]


def near_copies(n=60, seed=1):
    rng = random.Random(seed)
    base = [[rng.choice(WORDS) for _ in range(rng.choice([4, 30, 80]))] for _ in range(12)]
    out = []
    for _ in range(n):
        x = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            x[rng.randrange(len(x))] = rng.choice(WORDS)
        out.append(" ".join(x))
    return out


def shingles(text, k):
    w = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute_components(texts, k, percent):
    sets = [shingles(t, k) for t in texts]
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in range(len(texts))}


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


@pytest.mark.parametrize(("k", "percent", "small", "block"), [(3, 85, 16, 1024), (5, 80, 2, 5)])
def test_near_duplicates_brute_force(spark, monkeypatch, k, percent, small, block):
    monkeypatch.setattr(near_dup, "SMALL", small)
    monkeypatch.setattr(near_dup, "BLOCK", block)
    regular = thue_morse(2048)
    texts = [*near_copies(90), None, "", " \n\t", "one", "One", "ONE two", "É a b c", "É a b c", regular, regular.translate({97: "b", 98: "a"})]
    got = near_dup.near_duplicates(table(spark, texts), words=k, percent=percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == brute_components(texts, k, percent)


def test_near_duplicates_repeats_nulls_empty(spark):
    rows = near_dup.near_duplicates(table(spark, ["a b c", "a b c", "d e f", "a b c", "d e f"], [1, 1, 1, None, 9]), words=3, percent=85).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in rows) == [(-1, -1, True), (1, 1, True), (1, 1, True), (1, 1, True), (9, 1, False)]
    assert near_dup.near_duplicates(table(spark, [])).count() == 0


def test_components_of_a_path(spark):
    from chronofold.llm.runtime import components

    order = list(range(40))
    random.Random(3).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(39)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(40)} | {100: 100, 101: 100}


def brute_spans(texts, width):
    raw = [(t or "").encode() for t in texts]
    count = {}
    for b in raw:
        for p in range(len(b) - width + 1):
            count[b[p : p + width]] = count.get(b[p : p + width], 0) + 1
    out = []
    for b in raw:
        gone = [False] * len(b)
        for p in range(len(b) - width + 1):
            if count[b[p : p + width]] > 1:
                gone[p : p + width] = [True] * width
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("width", [200, 80])
def test_suffixes_brute_force(spark, width):
    rng = random.Random(5)
    word = lambda: rng.choice(["ab", "çé", "x", "lorem", "ipsum ", "\n"])
    text = lambda n: "".join(word() for _ in range(n))
    shared = [text(90) for _ in range(4)]
    texts = [text(rng.randrange(0, 60)) + rng.choice(shared) + text(rng.randrange(0, 200)) + rng.choice(["", rng.choice(shared)[: rng.randrange(150, 400)]]) for _ in range(40)]
    texts += [None, "", "a" * 1000, "ab" * 300, "a" * (width - 1), "b" * width, texts[0], texts[0]]
    got = suffixes.digest(suffixes.remove_repeats(table(spark, texts), width)).collect()
    mine = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got}
    assert mine == dict(enumerate(brute_spans(texts, width)))
    assert suffixes.remove_repeats(table(spark, [])).count() == 0


def test_suffixes_repeated_rows(spark):
    t = "".join(random.Random(1).choice("abcdef") for _ in range(400))
    got = suffixes.digest(suffixes.remove_repeats(table(spark, [t, t, t[:250]], [4, 4, None]))).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in got) == [(0, 250), (4, 400), (4, 400)]


def test_lines_brute_force(spark):
    rng = random.Random(2)
    pool = ["".join(rng.choice("abc é") for _ in range(rng.randrange(8, 40))) for _ in range(30)]

    def line():
        x = list(rng.choice(pool))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            i = rng.randrange(len(x))
            rng.choice([lambda: x.pop(i), lambda: x.insert(i, "z"), lambda: x.__setitem__(i, "q")])()
        return "".join(x)

    texts = ["\n".join(line() for _ in range(rng.randrange(1, 8))) for _ in range(30)] + [None, "", "\n\n", "short\nshort", long := "x" * 20000, long[1:], "y" + long[1:9000] + "z" + long[9000:], "".join(rng.choice("abc") for _ in range(3000))]
    lines = [(i, j, x.strip(" ")) for i, t in enumerate(texts) if t is not None for j, x in enumerate(t.split("\n")) if len(x.strip(" ")) >= 10]
    expected = {}
    for n, (i, j, x) in enumerate(lines):
        for a, b, y in lines[:n]:
            if x == y or edit_distance(x, y, 1) <= 1:
                expected[i, j] = (a, b)
                break
    got = {(r["doc_id"], r["line_no"]): (r["kept_doc_id"], r["kept_line_no"]) for r in line_dedup.duplicate_lines(table(spark, texts)).collect()}
    assert got == {k: survivor(expected, v) for k, v in expected.items()}
    left = {r["doc_id"]: r for r in line_dedup.drop_lines(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = t if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if (i, j) not in expected)
        assert left[i]["text"] == want and left[i]["a"] == 7
    assert line_dedup.duplicate_lines(table(spark, [])).count() == 0


def test_mixing_targets_and_reruns(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 200)), "en", rng.choice(["a", "b", "c", "d", None, "hot", "hot"]), 0, None, None, 7) for i in range(600)] + [(1, "x y", "en", "tiny", 0, None, None, 7)] * 3 + [(None, None, "en", "a", 0, None, None, 7)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(docs).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=repr)
    size, taken, target = {}, {}, {}
    for r in got:
        size[r["source"]] = size.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
    names = sorted(s for s in size if s is not None) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want, free, rest = {}, set(names), float(sum(size.values()))
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 3.0 * size[s]
        rest -= sum(want[s] for s in over)
        free -= over
    for s in names:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= max(5, 0.01 * target[s])
    assert mixing.mix(table(spark, [])).count() == 0
    assert [r["taken"] for r in mixing.mix(table(spark, [None, ""])).collect()] == [0, 0]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "odd<|says|>"]), st.text(alphabet=st.sampled_from(list("\\<>|/[]abINSTturnsayend s")), max_size=40)), max_size=5))
def test_chat_round_trip(turns):
    text, spans = chat.render(turns)
    assert chat.read_back(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    assert all(c not in chat.escape(t) for _, t in turns for c in chat.CONTROL)


def test_chat_layouts(spark):
    records = [
        {"messages": [{"role": "human", "content": "q", "id": 3}, {"role": "gpt", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "meta": {"x": 1}},
        {"instruction": "q", "input": "", "output": "a"}, {"prompt": "q", "completion": "a"}, {"question": "q", "answer": "a", "extra": None}, {"prompt": "q", "response": "a"},
    ]
    rows = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(90, None), (91, "{"), (92, "[1]"), (93, '{"else": 1}'), (94, '{"messages": []}')], "conv_id long, record string")
    got = {r["conv_id"]: (r["layout"], chat.read_back(r["formatted"])) for r in chat.format_chats(rows).collect()}
    for i in range(len(records)):
        assert got[i][1] == [("user", "q"), ("assistant", "a")], records[i]
    assert got[90] == got[91] == got[92] == got[93] == ("", []) and got[94] == ("messages", [])


def test_chat_pack_and_digest(spark):
    rows = spark.createDataFrame([(1, 1, "assistant", None), (1, 0, "user", "</s>[INST] ok [/INST]"), (2, 0, None, "x"), (2, 0, None, "x")], "conv_id long, turn long, role string, text string")
    d = {r["conv_id"]: r["d"] for r in chat.format_chats(chat.pack(rows)).withColumn("d", chat.digests()).collect()}
    assert d[1]["n_turns"] == 2 and d[1]["loss_chars"] == 0
    assert d[1]["turns_sha256"] == hashlib.sha256(b"user\n</s>[INST] ok [/INST]\nassistant\n\n").hexdigest()
    assert d[2]["turns_sha256"] == hashlib.sha256(b"\nx\n\nx\n").hexdigest()


def test_simhash_edits_and_fingerprints(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 120))) for _ in range(40)] + [None, "", "é", "same text here", "same text here"]
    ids = [i * 3 for i in range(len(texts))]
    got = {r["doc_id"]: r for r in simhash.compare(table(spark, texts, ids)).collect()}
    for n, i in enumerate(ids):
        t, nxt = texts[n] or "", texts[(n + 1) % len(texts)] or ""
        q = len(t) // 4
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest()
        bits = int(got[i]["fingerprint"], 16) ^ int(got[i]["edited_fingerprint"], 16)
        assert got[i]["near_edited"] == 1 - bin(bits).count("1") / 64
    assert got[ids[-1]]["fingerprint"] == got[ids[-2]]["fingerprint"]
    near = [got[i] for n, i in enumerate(ids) if len(texts[n] or "") > 200]
    assert sum(r["near_edited"] > r["near_next"] for r in near) >= 0.9 * len(near)
    assert simhash.compare(table(spark, [])).count() == 0
    again = simhash.compare(table(spark, ["a b c d e", "a b c d e", "x y"], [1, 1, None])).collect()
    assert len(again) == 3


def test_simhash_radius(spark):
    rng = random.Random(7)
    values = [rng.getrandbits(64) for _ in range(40)]
    values += [v ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))) for v in values]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = {tuple(r) for r in simhash.within(spark.createDataFrame([(v,) for v in signed], "bits long"), 3).collect()}
    assert got == {(a, b) for a in set(signed) for b in set(signed) if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 3}


def luhn(d):
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def brute_pii(text):
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for n, (k, p) in enumerate(plain.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": k != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[k]:
                out.append((m.start(), n, m.end(), k))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_pii_base_brute_force(spark):
    rng = random.Random(8)
    parts = ["a@b.c", "x.y+z@mail-1.example.com", "@", ".", "..", "-", " ", "  ", "é", "\ue000", "\ue001", "4111 1111 1111 1111", "4111111111111111", "4111-1111 1111-1111", "1.2.3.4", "300.1.2.3", "007.1.1.255", "+1 (555) 123-4567", "+", "12", "3", "a", "_", "\n", "+90 212"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(400)] + [None, "", "1" * 30000, "1 " * 20000, "a." * 20000, "a" * 50000, "a@b." + "c." * 9000, "1.1.1." * 3000 + "1"]
    got = {r["doc_id"]: r for r in pii.digest(pii.find(table(spark, texts))).collect()}
    for i, t in enumerate(texts):
        assert got[i]["base_sha256"] == hashlib.sha256(brute_pii(t).encode()).hexdigest(), t[:200]
    assert pii.find(table(spark, [])).count() == 0


def test_pii_bootstrap_finds_unseen(spark):
    texts = [f"please call me on +1 555 123 {1000 + i} now" for i in range(8)] + [f"reach me at user{i}@mail.example.com today" for i in range(8)]
    texts += ["reach me at anna[at]mail.example.com today", "order number is 77 on 2024-01-01", "we saw b4 there", "please call me on 555 123-2000, thanks", "please call me on time"]
    found = {r["doc_id"]: r for r in pii.digest(pii.find(table(spark, texts))).collect()}
    at = texts[16].index("anna")
    assert found[16]["spans"] == f"email:{at}:{at + 24}" and found[16]["n_email"] == 0
    assert found[17]["spans"] == found[18]["spans"] == found[20]["spans"] == ""
    assert found[19]["spans"] == "phone:18:30"
    assert all(found[i]["n_phone"] == 1 for i in range(8))


def test_decontaminate_reordered(spark):
    item = " ".join(f"t{i}" for i in range(30))
    w = item.split()
    texts = ["x " * 20 + item, "noise " + " ".join(w[15:]) + " more words between " + " ".join(w[:15]), " ".join(w[:20]), "T0, t1! " + " ".join(w[2:]), None, "", "clean text of other words " * 5, "one two"]
    bench = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, "", "x"), (4, "one two", "x")], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(table(spark, texts), bench).collect()}
    assert set(got) == {(0, 1), (1, 1), (3, 1), (7, 4)}
    assert got[1, 1]["tiles"] == 2 and got[1, 1]["covered_words"] == 30 and got[1, 1]["longest"] == 15
    blocks = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(table(spark, texts), bench, block_words=10).collect()}
    assert blocks == set(got)
    assert decontaminate.contaminated(table(spark, []), bench).count() == 0
    assert decontaminate.contaminated(table(spark, texts), bench.limit(0)).count() == 0


def brute_tiles(text, item, least):
    """Greedy tiling by plain search: the longest run that nothing covers, the first in the item, then in the text."""
    a, b, out = [False] * len(item), [False] * len(text), []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and not a[i + n] and not b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        a[i : i + n] = b[j : j + n] = [True] * n
        out.append((i, j, n))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.lists(st.integers(0, 3), min_size=3, max_size=20))
def test_tiles_brute_force(text, item):
    import numpy as np

    t, i = np.array(text, dtype=np.uint64), np.array(item, dtype=np.uint64)
    got = decontaminate.tiles(t, i, decontaminate._runs(t, 3), decontaminate._runs(i, 3), 3)
    assert got == brute_tiles(text, item, 3)
    assert decontaminate._tiles_by_length(t, i, 3) == got


def test_tiles_of_repetitive_texts():
    import numpy as np

    t, i = np.full(60_000, 7, dtype=np.uint64), np.full(4_000, 7, dtype=np.uint64)
    i[[1000, 2500]] = 9
    got = decontaminate.tiles(t, i, decontaminate._runs(t, 5), decontaminate._runs(i, 5), 5)
    assert sorted(n for _, _, n in got) == [1000, 1499, 1499]


def test_toxicity(spark):
    assert toxicity.fold("ＩＤ10Т, Ιdíоt!") == " idiot idiot "
    model = toxicity.default_model()
    texts = ["you idi0t", "y0u are a ѕtupid mοron", "the trash can is full", "a clean text", None, "", "word " * 5000]
    got = {r["doc_id"]: r for r in toxicity.score(table(spark, texts), model).collect()}
    assert got[0]["score"] > 0.5 and got[1]["score"] > 0.7 and got[0]["a"] == 7
    assert got[2]["score"] == got[3]["score"] == got[4]["score"] == got[5]["score"] == got[6]["score"] < 0.1


def test_toxicity_learns_beginnings(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(6))
    texts = [" ".join(word() for _ in range(40)) + (f" zorg{word()} {word()} zorg{word()}" if i % 3 == 0 else "") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 1) for i in range(300)] + [(0, 1, 1), (None, 1, 1), (7, None, 1), (9999, 1, 1)], "doc_id long, toxic int, quality int")
    got = toxicity.classify(table(spark, texts), labels).collect()
    assert all(r["predicted"] == (r["doc_id"] % 3 == 0) for r in got)
    assert {r["held_out"] for r in got} == {True, False}
    assert toxicity.classify(table(spark, texts), labels.limit(0)).count() == 300
    assert toxicity.classify(table(spark, []), labels).count() == 0


def test_language(spark):
    rng = random.Random(10)
    abc = {"aa": "abcde", "bb": "vwxyz"}
    texts, langs = [], []
    for i in range(160):
        lang = ("aa", "bb")[i % 2]
        texts.append(" ".join("".join(rng.choice(abc[lang]) for _ in range(5)) for _ in range(rng.randrange(2, 30))))
        langs.append(lang)
    texts += [None, "", "123 !?", "ВЕСЬ", "\U00010400"]
    docs = spark.createDataFrame([(i, t, langs[i] if i < 160 and i % 7 else None, 5) for i, t in enumerate(texts)], "doc_id long, text string, lang string, score long")
    got = {r["doc_id"]: r for r in language.identify(docs).collect()}
    assert all(got[i]["lang_pred"] == langs[i] for i in range(160))
    assert [got[i]["lang_pred"] for i in (160, 161, 162)] == ["und"] * 3 and got[160]["score"] == 0
    assert got[163]["lang_pred"] in ("aa", "bb") and got[164]["lang_pred"] in ("aa", "bb") and all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in language.identify(docs.withColumn("lang", docs.lang.substr(9, 1).cast("string")).where("lang is null")).collect()} == {"und"}
    assert language.identify(docs.limit(0)).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet="aB \n\té", max_size=12), min_size=1, max_size=6))
def test_kernel_words(texts):
    import pyarrow as pa

    raw, offsets = kernels.buffers(pa.array(texts))
    w = kernels.Words(raw, offsets)
    got = [raw[a:b].tobytes().decode() for a, b in zip(w.start, w.end, strict=True)]
    assert got == [x for t in texts for x in re.findall(r"[^ \t-\r]+", t)]
    for k in (1, 3):
        h, at = w.shingles(k)
        for d, t in enumerate(texts):
            assert len(set(h[w.doc[at] == d].tolist())) == len(shingles(t, k))


def test_kernel_words_of_regular_texts():
    import pyarrow as pa

    words = [thue_morse(n) for n in (64, 65, 128, 1024, 4096, 1 << 16)]
    words += [w.translate({97: "b", 98: "a"}) for w in words] + ["a" * n for n in (1, 7, 8, 9, 63, 64, 65)] + ["a\0", "a\0\0"]
    raw, offsets = kernels.buffers(pa.array(words))
    assert len(set(kernels.Words(raw, offsets).hash.tolist())) == len(words)
