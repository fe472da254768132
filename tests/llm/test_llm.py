"""Training-data operators against brute force, and on nulls, empty and repeated rows and clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from compare import same
from pyspark.sql import functions as F

from millrace.llm import chat, decontaminate, jobs, licenses, neardup, packing, substring, text, tokens, topk, toxicity, urls
from millrace.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(n, seed):
    rng = random.Random(seed)
    return [rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n)]


def table(spark, rows, columns="doc_id long, text string"):
    return spark.createDataFrame(rows, columns)


def table_of(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def documents(duck):
    return duck.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    same(df.collect(), df.columns, duck.execute(ORACLE_SQL[name]))


LONG = " ".join(prose(5000, 1))
ODD = [(1, None, 5, "a"), (2, "", 5, None), (3, LONG, 5, "a"), (3, LONG, 5, "a"), (4, "x", None, "a"), (5, LONG, 1, "a"), (None, "no id", 1, "b"), (6, "\t\n ", 1, "b"), (7, "Alpha, BETA!", 1, "b")]


def _sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def _odd(name):
    """What each query says of the rows ODD: nulls, empty, long and repeated texts."""
    words, shingles = 5000, len({tuple(LONG.split()[i : i + 5]) for i in range(4996)})
    ids = [r[0] for r in ODD]
    size = dict(zip(ids, (0, 0, words, words, 1, words, 2, 0, 2), strict=True))
    pad = lambda *c: sorted(zip(ids, *c, strict=True), key=repr)
    n = [size[i] for i in ids]
    return {
        "op1_decontamination": [(7, 3, 0, 2, 1.0, 0), (7, None, 0, 2, 1.0, 0)],
        "op3_licenses": pad(n, [0] * 9, [None] * 9, [None] * 9, [""] * 9, [""] * 9, [0.0] * 9, [[]] * 9),
        "op5_minhash_near_dedup": pad([{0: 0, words: shingles}.get(x, 1) for x in n], [3 if x == words else i for i, x in zip(ids, n, strict=True)], [i != 5 for i in ids]),
        "op10_substring_dedup": pad(n, [words if i == 5 else 0 for i in ids], [_sha("" if t is None or i == 5 else " ".join(t.split())) for i, t, *_ in ODD]),
    }[name]


@pytest.mark.parametrize("name", ["op1_decontamination", "op3_licenses", "op4_packing", "op5_minhash_near_dedup", "op8_toxicity", "op9_token_counts", "op10_substring_dedup"])
def test_odd_rows(spark, tmp_path, name):
    """Nulls, empty and long texts, repeated rows, empty tables, further columns of clashing names."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, n long, id string").withColumns({"lang": F.lit("en"), "h": F.lit(1), "g": F.lit(1), "key": F.lit("k"), "start": F.lit(0), "bucket": F.lit(9), "size": F.lit(2), "_text": F.lit("t")})
    for sub, frame in (("full", df), ("empty", df.limit(0))):
        folder = str(tmp_path / sub)
        frame.write.parquet(f"{folder}/documents.parquet")
        table(spark, [(1, None), (2, ""), (3, "alpha beta"), (None, "alpha beta")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        table(spark, [(1, 0, 1), (3, 1, 0), (9, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        rows = QUERIES[name](spark, folder).collect()
        if sub == "empty":
            assert not rows
        elif name == "op4_packing":
            assert sorted(((r["doc_id"], r["n_tokens"]) for r in rows), key=repr) == sorted(((i, n) for i, n, *_ in _odd("op3_licenses")), key=repr)
            assert all(r["bucket_tokens"] - r["n_tokens"] == r["padding"] >= 0 for r in rows) and len({(r["bucket"], r["batch"], r["place"]) for r in rows}) == len(ODD)
        elif name == "op8_toxicity":
            by = collections.defaultdict(set)
            for r in rows:
                by[r["doc_id"]].add((r["score"], r["predicted"], r["held_out"]))
            assert len(rows) == len(ODD) and all(len(x) == 1 and 0 <= min(x)[0] <= 1 for x in by.values())
            assert len({min(by[i])[0] for i in (1, 2, 6)}) == 1 and min(by[3])[0] == min(by[5])[0]
            assert by[None] == {(min(by[None])[0], min(by[None])[1], None)} or all(x[2] in (True, False) for x in by[None])
        elif name == "op9_token_counts":
            pieces = tokens.Trie(tokens.load_vocabulary())
            expected = [(i, sum(pieces.count([t]) for t in p), len(p)) for i, t, *_ in ODD for p in [tokens.PRETOKEN.findall(t or "")]]
            assert sorted(map(tuple, rows), key=repr) == sorted(expected, key=repr)
        else:
            assert sorted(map(tuple, rows), key=repr) == sorted(_odd(name), key=repr)


def test_tables_of_a_scope_go_with_it_and_settings_come_back(spark, tmp_path):
    import os

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1234")
    try:
        with jobs.scope(spark) as folder:
            rows = neardup.link_classes(table(spark, [(1, "a b c d e f"), (2, "a b c d e f")])).collect()
            assert os.listdir(folder.removeprefix("file://"))
        assert {r["component_id"] for r in rows} == {1} and not os.path.exists(folder.removeprefix("file://"))
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1234" and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# 1


def _leaks(docs, items):
    """(doc_id, item_id) by exact similarity of every window."""

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))

    shingles = {i: [tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))] for i, t in items if (w := words(t))}
    df = collections.Counter(s for ss in shingles.values() for s in set(ss))
    weight = lambda c: sum(n / max(1, df[s]) for s, n in c.items())
    out = set()
    for d, t in docs:
        w = words(t)
        own = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
        for i, ss in shingles.items():
            if not set(own) & set(ss):
                continue
            for j in range(max(1, len(own) - len(ss) + 1)):
                a, b = collections.Counter(own[j : j + len(ss)]), collections.Counter(ss)
                if weight(a & b) / max(weight(a), weight(b)) >= 0.8:
                    out.add((d, i))
    return out


def test_decontamination_against_brute_force(spark, duck):
    expected = _leaks(documents(duck), duck.execute("SELECT item_id, text FROM benchmark").fetchall())
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op1_decontamination"](spark, SF).collect()}
    assert got == expected and got


def test_decontamination_sees_through_case_breaks_and_edits(spark):
    item = prose(40, 2)
    near = [*item[:20], "changed", *item[21:]]
    other = prose(300, 3)
    docs = [(1, " ".join(other + item)), (2, "\n".join(w.upper() + "," for w in item)), (3, " ".join(other[:50] + near + other[50:])), (4, " ".join(other)), (5, " ".join(item[:20]))]
    bench = table(spark, [(7, " ".join(item)), (8, "a b"), (9, "")], "item_id long, text string")
    df = table(spark, [*docs, (6, "so a B it is")])
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(df, bench).collect()}
    assert set(got) == {(1, 7), (2, 7), (3, 7), (6, 8)}
    assert got[1, 7]["start_word"] == 300 and got[1, 7]["distance"] == 0 and got[3, 7]["similarity"] < 1
    assert {r["doc_id"] for r in decontaminate.decontaminate(df, bench).collect()} == {4, 5}


def test_decontamination_is_the_same_in_any_number_of_passes(spark, monkeypatch):
    boiler = prose(12, 70)
    items = [(i, " ".join(boiler + prose(18, 71 + i))) for i in range(12)] + [(21, None)]
    # without the last 3 words of an item 0.84 of it is left; without the last 4, 0.79, but 0.85 were its boilerplate its own
    docs = [(i, " ".join(prose(30, 200 + i) + boiler + prose(15 if i < 6 else 14, 71 + i) + prose(20, 400 + i))) for i in range(12)]
    df, bench = table(spark, docs), table(spark, items, "item_id long, text string")
    rows = lambda: (sorted(map(tuple, decontaminate.contaminated(df, bench).collect())), sorted(r[0] for r in decontaminate.decontaminate(df, bench).collect()))
    whole = rows()
    assert {i for _, i, *_ in whole[0]} == {*range(6)} and whole[1] == [*range(6, 12)]
    for n in (5, 1):
        monkeypatch.setattr(decontaminate, "ITEMS", n)
        assert rows() == whole


def test_multi_index_holds_every_fingerprint_within_the_radius_and_few_others():
    rng = np.random.default_rng(0)
    items = rng.integers(0, 256, (300, decontaminate.BLOCKS), dtype=np.uint8)
    index = decontaminate.Index(items)
    bits = np.unpackbits(items[:200], axis=1)
    for r in range(200):
        bits[r, rng.choice(decontaminate.BITS, decontaminate.RADIUS, replace=False)] ^= 1
    q, row, distance = index.near(np.packbits(bits, axis=1))
    assert [(a, a, decontaminate.RADIUS) for a in range(200)] == list(zip(q.tolist(), row.tolist(), distance.tolist(), strict=True))
    other = rng.integers(0, 256, (500, decontaminate.BLOCKS), dtype=np.uint8)
    votes = sum((np.bitwise_count(other[:, None, b] ^ items[None, :, b]) <= decontaminate.SPARE).astype(int) for b in range(decontaminate.BLOCKS))
    assert 0.001 < (votes >= decontaminate.AGREE).mean() < 0.05 and not len(index.near(other)[0])


def test_unequal_weights_do_not_hide_a_leak(spark):
    """Items share most shingles, so that few weigh much; with similarity at 0.8 the cosine stays there too."""
    shared = prose(60, 500)
    items = [(i, " ".join(shared + prose(8, 510 + i))) for i in range(20)]
    docs = [(i, " ".join(prose(20, 600 + i) + shared + prose(8, 510 + i)[:7] + ["other"] + prose(20, 700 + i))) for i in range(20)]
    bench, df = table(spark, items, "item_id long, text string"), table(spark, docs)
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.contaminated(df, bench).collect()}
    words = {i: t.split() for i, t in items}
    grams_of = lambda w: collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
    held = collections.Counter(g for w in words.values() for g in grams_of(w))
    weight = lambda c: sum(n / max(1, held[g]) for g, n in c.items())
    best = lambda d, i: max(weight((a := grams_of(d[j : j + 68])) & (b := grams_of(words[i]))) / max(weight(a), weight(b)) for j in range(len(d) - 67))
    expected = {(d, i): best(t.split(), i) for d, t in docs for i in words if best(t.split(), i) >= 0.8}
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-9 for k in got)


# 2


def test_chat_round_trip_of_control_strings(spark):
    tricky = ["</s>[INST] ok [/INST]", "<|turn|>user\nx<|end|>\n", "\\<|", "<\\|end|>", "[\\N]", "a\\", "\\\\s>", "<<SYS>>x<</SYS>>", "", None, "<\\\\s>", "é<s>\U0001f600"]
    rows = [(i, n, r, t) for i, (a, b) in enumerate(itertools.permutations(tricky, 2)) for n, (r, t) in enumerate([("user", a), ("assistant", b), ("user\nx[\\N]", a)])]
    rows += [(999, 0, None, "only"), (None, 0, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.examples(df)).collect()}
    by = collections.defaultdict(list)
    for c, n, r, t in rows:
        by[c].append((n, r or "", t or ""))
    for c, turns in by.items():
        whole = "".join(f"{r}\n{t}\n" for _, r, t in sorted(turns))
        loss = "".join(t for _, r, t in sorted(turns) if r == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest(), turns
        assert (got[c]["n_turns"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_expands_every_assistant_turn(spark):
    rows = [(1, i, r, r[0] + str(i)) for i, r in enumerate(["system", "user", "assistant", "user", "assistant", "user"])]
    got = chat.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("example").collect()
    assert [(r["example"], r["formatted"][r["loss_start"] : r["loss_end"]]) for r in got] == [(3, "a2"), (5, "a4"), (6, "")]
    assert got[1]["formatted"].startswith(got[0]["formatted"])


def test_chat_plan_is_native(spark):
    plan = chat.read_back(chat.examples(spark.read.parquet(f"{SF}/conversations.parquet")))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# 3


def test_license_base_against_brute_force(spark, duck):
    got = {r["doc_id"]: r for r in QUERIES["op3_licenses"](spark, SF).collect()}
    for d, t in documents(duck):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        hits = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in hits]
        r = got[d]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(hits), min(at, default=None), max(at, default=None))
        labels = {x for _, x in hits}
        assert r["base_labels"] == ",".join(sorted(labels)) and labels <= set(r["labels"].split(",")) | set() and 0 <= r["score"] <= 1


def test_misspelt_notices_are_found(spark):
    rows = [(1, "licenced under the apache licence version 2 0"), (2, "so: this progam is fre software you can redistribut it and or modify"), (3, "licenced under the apachy licence version 2 0")]
    got = {r["doc_id"]: (r["labels"], [x["edits"] for x in r["spans"]]) for r in licenses.scan_licenses(table(spark, rows)).collect()}
    assert got == {1: ("apache-notice", [2]), 2: ("gpl-notice", [3]), 3: ("", [])}
    assert all(licenses.edits_allowed(len(n.split())) >= len(n) // 30 for n in licenses.NOTICES)


def test_every_edit_within_bounds_is_found(spark):
    rng = random.Random(4)
    rows, expected = [], {}
    for notice, label in licenses.NOTICES.items():
        for k in range(licenses.edits_allowed(len(notice.split())) + 1):
            for _ in range(6):
                chars = list(notice)
                for place in rng.sample(range(1, len(chars) - 1), k):
                    kind = rng.choice("sid")
                    chars[place] = {"s": rng.choice("qxz"), "i": chars[place] + rng.choice("qxz"), "d": ""}[kind]
                n = len(rows)
                rows.append((n, " ".join(prose(20, n)) + ". " + "".join(chars).upper() + ", " + " ".join(prose(20, -n))))
                expected[n] = label, k
    for r in licenses.scan_licenses(table(spark, rows)).collect():
        label, k = expected[r["doc_id"]]
        assert label in r["labels"].split(",") and min(s["edits"] for s in r["spans"] if s["label"] == label) <= k, (rows[r["doc_id"]], r)


# 4


def test_boundaries_are_optimal():
    rng = random.Random(1)
    for _ in range(40):
        lengths = sorted(rng.sample(range(1, 60), rng.randrange(3, 9)))
        counts = [rng.randrange(1, 9) for _ in lengths]
        k = rng.randrange(1, 4)

        def padding(ends):
            return sum(c * (min(e for e in ends if e >= x) - x) for x, c in zip(lengths, counts, strict=True))

        best = min(padding([*e, lengths[-1]]) for n in range(k) for e in itertools.combinations(lengths[:-1], n))
        assert padding(packing.boundaries(np.array(lengths), np.array(counts), k)) == best


def test_packing_keeps_every_document_within_budget(spark, duck):
    rows = QUERIES["op4_packing"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == [d for d, _ in documents(duck)]
    batches = collections.defaultdict(list)
    for r in rows:
        batches[r["bucket"], r["batch"]].append(r)
        assert r["padding"] == r["bucket_tokens"] - r["n_tokens"] >= 0
    for b in batches.values():
        assert len(b) == 1 or len(b) * b[0]["bucket_tokens"] <= packing.BUDGET
        assert sorted(r["place"] for r in b) == list(range(len(b)))
    per = collections.Counter(k for k, _ in batches)
    assert all(n == len({b for x, b in batches if x == k}) and sum(len(batches[k, i]) < max(len(batches[k, j]) for j in range(n)) for i in range(n)) <= 1 for k, n in per.items())
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in documents(duck)}


# 5


def _components(docs, percent=85):
    sets = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_near_dedup_against_brute_force(spark, duck):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op5_minhash_near_dedup"](spark, SF).collect()}
    assert got == _components(documents(duck))


@pytest.mark.parametrize("percent", [85, 80])
def test_near_dedup_of_chains_and_groups(spark, percent):
    """A group of edited copies whose links go through others, chains, short texts, empties."""
    rng = random.Random(6)
    base = prose(120, 5)
    docs = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(30)}"
        docs.append((1000 - i, " ".join(w)))
    chain = prose(100, 8)
    for i in range(20):
        chain = [*chain[2:], *prose(2, 100 + i)]
        docs.append((i, " ".join(chain)))
    docs += [(2000, "a b"), (2001, "A  b"), (2002, "a b c"), (2003, ""), (2004, None), (2005, " ")]
    rng.shuffle(docs)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.link_classes(table(spark, docs), percent).collect()}
    assert got == _components(docs, percent)


@pytest.mark.parametrize("paired", [False, True])
def test_buckets_of_a_template_family_are_not_paired_whole(spark, monkeypatch, paired):
    """160 of 200 words are common to all; the rest is a document's own, or common to two that differ in more than the threshold allows."""
    common, docs = prose(160, 900), []
    for i in range(240):
        own = prose(40, 1000 + i // 2 if paired else 1000 + i)
        docs.append((i, " ".join(common + (own[:28] + prose(12, 5000 + i) if paired else own))))
    docs += [(1000 + i, docs[i][1] + " tail") for i in range(6)]
    seen = []
    own = neardup.across
    monkeypatch.setattr(neardup, "across", lambda *a: seen.append(own(*a).count()) or own(*a))
    got = {r["doc_id"]: r["component_id"] for r in neardup.link_classes(table(spark, docs)).collect()}
    assert got == {d: c for d, (_, c) in _components(docs, 85).items()}
    assert seen and seen[0] <= 2 * len(docs)


def test_circulant_signature_estimates_similarity():
    a = np.arange(1000, dtype=np.uint64)
    sets = [text.mix(x.copy()) for x in (a, a + np.uint64(100), a + np.uint64(500))]
    sig = neardup.signatures(np.concatenate(sets), np.array([0, 1000, 2000]))
    for i, share in ((1, 900 / 1100), (2, 500 / 1500)):
        assert abs((sig[:, 0] == sig[:, i]).mean() - share) < 0.15


# 6


@pytest.mark.parametrize(
    "url,host,path,rule,verdict",
    [
        ("http://A.Example.COM/en/x?q", "a.example.com", "/en/x", "example.com/en/", "block"),
        ("https://www.example.com/en/1#t", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("https://m.www.example.com/en/", "m.www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://a.com", "a.com", "", None, "allow"),
        ("http://com/", "com", "/", "com/", "allow"),
        ("http://telecom/", "telecom", "/", None, "allow"),
        ("http://x.net/es/?a", "x.net", "/es/", "net/es/", "block"),
        ("http://x.net/es", "x.net", "/es", None, "allow"),
        ("x://y?z://w/", "y", "", None, "allow"),
        ("http:/a.com/", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
    ],
)
def test_url_rules(url, host, path, rule, verdict):
    assert urls.split_url(url) == (host, path)
    got = urls.match_rule(host, path)
    assert (got[0] if got else None) == rule
    assert (got[1] if got else "block" if urls.block_odds(urls.url_words(host, path)) > 0 else "allow") == verdict


def test_host_words_and_bayes():
    assert urls.segment("cheapviagrapills") == ["cheap", "viagra", "pills"]
    assert urls.segment("bestonlinecasino") == ["best", "online", "casino"]
    assert "".join(urls.segment("qqthenewszz")) == "qqthenewszz" and urls.segment("") == []
    odds = lambda h, p="": urls.block_odds(urls.url_words(h, p))
    assert odds("spam-farm.example.org", "/en/1") > 0 and odds("freecasinobets.org") > 0
    assert odds("cityhistorymuseum.org", "/en/article") < 0 and odds("thering.org") < 0


@pytest.mark.parametrize("host", "porn.org casino.org viagra.org escort.org payday-loan.org onlinegambling.org casino-win.org free-bets.org ads-track.org adult-x.org spam-farm.org cheap-pills.org".split())
def test_words_alone_block_unwanted_hosts(host):
    labels = host.removesuffix(".org")
    for name in (host, f"www.{labels}.example.org", f"m.{labels}.example.net"):
        assert urls.block_odds(urls.url_words(name, "/en/81.html")) > 0


def test_unwanted_hosts_of_the_pages_are_blocked_without_a_rule_and_others_allowed(spark, tmp_path):
    bad = ("casino-win", "free-bets", "ads-track", "adult-x", "spam-farm", "cheap-pills")
    hosts = {r[0] for r in table_of(spark, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1)).distinct().collect()}
    rows = [(i, f"http://{h.replace('.com', '.org')}/de/{i}.html?x=1") for i, h in enumerate(sorted(hosts))]
    rows += [(1000 + i, f"https://{s}{b}.example.net/en/9") for i, (s, b) in enumerate(itertools.product(("", "www.", "m.", "blog."), bad))]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r["verdict"] for r in QUERIES["op6_url_filter"](spark, str(tmp_path)).collect()}
    assert got == {i: "block" if any(b in u for b in bad) else "allow" for i, u in rows}


def test_url_parts_and_rules_against_sql(spark, duck):
    rules = ", ".join(str(r) for r in urls.RULES)
    want = duck.execute(f"""
        WITH u AS (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS mark FROM pages
        ), a AS (SELECT page_id, CASE WHEN mark > 0 THEN substr(url, mark + 3) ELSE '' END AS rest FROM u
        ), b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a
        ), c AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b
        ), r AS (SELECT * FROM (VALUES {rules}) x(rh, rp, verdict)
        ), m AS (SELECT page_id, max((length(rh || rp), rh || rp, verdict)) AS best FROM c JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY 1)
        SELECT c.page_id, host, path, best[2] AS rule, best[3] AS verdict FROM c LEFT JOIN m USING (page_id)""").fetchall()
    got = {r["page_id"]: r for r in QUERIES["op6_url_filter"](spark, SF).collect()}
    assert len(want) == len(got)
    for page, host, path, rule, verdict in want:
        r = got[page]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] == (verdict or r["verdict"])


def test_segmentation_and_bayes_against_brute_force():
    known = {"a": -1.0, "ab": -1.5, "abc": -3.0, "b": -2.5, "bc": -1.2, "c": -2.0, "ca": -1.1}
    unknown = -math.log(len(known) + 10) - 4

    def best(text):
        """Least loss over all ways to cut the text."""
        ways = []
        for cuts in itertools.product((False, True), repeat=len(text) - 1):
            at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(text)]
            ways.append(sum(known.get(text[x:y], unknown if y - x == 1 else -math.inf) for x, y in itertools.pairwise(at)))
        return max(ways)

    for text_ in ("abc", "abca", "xabcx", "cabcabx", "bbca", "xx"):
        cost = sum(known[w] if w in known else unknown * len(w) for w in urls.segment(text_, (known, 3)))
        assert "".join(urls.segment(text_, (known, 3))) == text_ and abs(cost - best(text_)) < 1e-9
    odds, prior = urls.learn([["good", "day"], ["good"]], [["bad", "day", "bad"]])
    # five distinct outcomes: three words, one unseen, and "day" in both
    assert prior == math.log(1 / 2) and abs(odds["bad"] - math.log((3 / 7) / (1 / 7))) < 1e-9 and abs(odds["day"] - math.log((2 / 7) / (2 / 7))) < 1e-9


def test_labelled_hosts_left_out_are_judged_by_the_others():
    sides = [[urls.segment(h) for h in side.split()] for side in (urls.url_examples.WANTED, urls.url_examples.UNWANTED)]
    right = [0, 0]
    for fold in range(10):
        model = urls.learn(*([w for i, w in enumerate(side) if i % 10 != fold] for side in sides))
        for label, side in enumerate(sides):
            right[label] += sum((urls.block_odds(w, model) > 0) == bool(label) for i, w in enumerate(side) if i % 10 == fold)
    assert right[0] / len(sides[0]) > 0.85 and right[1] / len(sides[1]) > 0.55


def test_url_words_come_from_the_vocabulary_and_the_prior_from_the_labelled_hosts():
    assert urls.segment("onlinegambling") == ["online", "gambling"] and urls.segment("mountainrailway") == ["mountain", "railway"]
    assert len(urls.lexicon()[0]) > 20_000
    assert urls.learn([["a1"], ["b1"], ["b1"]], [["c1"]])[1] == math.log(1 / 3)
    assert all(urls.block_odds(urls.url_words(h, "/en/8")) < 0 for h in ("library.org", "blog.tionsh.example.net", "www.therin.example.org", "movie-reviews.org"))


# 7


def test_top_k_against_brute_force_with_odd_vectors(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(size=20).astype(np.float32).tolist()) for i in range(300)]
    vectors += [(i, vectors[0][1]) for i in range(400, 460)]
    vectors += [(500, None), (550, [float("nan")] * 20), (600, [1.0] * 19 + [None]), (650, [float("inf")] * 20), (700, [0.0] * 20), (None, [1.0] * 20), (750, [1.0] * 7)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = topk.top_k(df.repartition(5), F.col("vec_id") % 50 == 0).collect()
    good = {i: [math.floor(256 * x) for x in v] for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    expected = set()
    for q in good:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(good[q], v, strict=True)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:5]
            expected |= {(q, n, i, -s) for n, (s, i) in enumerate(best, 1)}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == expected
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_of_repeated_ids_in_several_passes(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i % 40, rng.normal(size=9).astype(np.float32).tolist()) for i in range(120)] + [(0, [])] * 2 + [(7, [])]
    rows += rows[:3]
    df = table(spark, rows, "vec_id long, embedding array<float>")
    good = [(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows]
    expected = []
    for q, v in sorted(set(good)):
        if q % 10 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v))[:5]
            expected += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    for size in (8192, 3):
        monkeypatch.setattr(topk, "QUERIES", size)
        assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 10 == 0).collect())) == sorted(expected)


def test_later_tiles_are_cut_from_the_start():
    rng = np.random.default_rng(6)
    low = rng.normal(size=(64, 3000)) * np.exp(-np.arange(64) / 6)[:, None]
    queries = np.floor(256 * low[:, :10].T)
    best = topk.Best(np.arange(10), queries, 5)
    summed = [best.add(np.floor(256 * low[:, a : a + 500]), np.arange(a, a + 500)) for a in range(0, 3000, 500)]
    scores = queries @ np.floor(256 * low)
    scores[np.arange(10), np.arange(10)] = -np.inf
    order = np.lexsort((np.broadcast_to(np.arange(3000), scores.shape), -scores), axis=1)[:, :5]
    assert (best.ids == order).all() and summed[-1] < 0.02 * 10 * 500


# 8


def test_toxicity_learns_words_and_density_on_held_out_rows():
    rng = random.Random(9)
    bad = ["idiot", "scum", "moron", "trash", "clown"]
    texts, labels = [], []
    for i in range(1200):
        w = prose(rng.randrange(20, 120), i)
        toxic = i % 4 == 0
        for _ in range(len(w) // 12 + 1 if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(bad)
        texts.append(toxicity.bins(text.one(" ".join(w), text.ALNUM)))
        labels.append(float(toxic))
    labels = np.array(labels)
    model = toxicity.fit(texts[:900], labels[:900])
    score, _ = toxicity.scores(model, model.tables(), toxicity.known_bins(), *toxicity.pad(*toxicity._joined(texts[900:])))
    assert ((score >= 0.5) == labels[900:]).mean() > 0.97
    one_by_one = [toxicity.scores(model, model.tables(), toxicity.known_bins(), *toxicity.pad(*toxicity._joined([t])))[0][0] for t in texts[900:910]]
    assert np.allclose(one_by_one, score[:10])


def test_toxicity_cuts_by_language_go_both_ways_and_fall_back():
    # logits (toxic, clean) by language: en cuts at 0, fr below it, de above it; es has four toxic rows only; -1 has no language
    parts = {0: ([1] * 30, [-1] * 60), 1: ([-2] * 6, [-4] * 9), 2: ([3] * 6, [1.5] * 9), 3: ([-3] * 4, [0.5] * 3), -1: ([], [-1] * 5)}
    rows = [(x, i, t) for i, sides in parts.items() for t, side in zip((1.0, 0.0), sides, strict=True) for x in side]
    logits, lang, labels = (np.array(c) for c in zip(*rows, strict=True))
    en, fr, de, es, none = toxicity.cuts(logits, lang, labels)
    assert (en, fr, de) == (0, -3, 2.25) and es == none == toxicity.threshold(logits, labels, 0.0) and fr < none < de


def test_toxicity_fit_uses_a_lower_cut_of_a_language(monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "threshold", lambda logits, labels, fallback: seen.append(len(labels)) or (1.0 if len(seen) == 1 else -1.0))
    rng = random.Random(4)
    texts, labels = [], []
    for i in range(400):
        w = [*rng.choice(list(toxicity.LANGUAGES.values())).split(), *prose(20, i), *(["scum"] * 3 if i % 2 else [])]
        texts.append(toxicity.bins(text.one(" ".join(w), text.ALNUM)))
        labels.append(float(i % 2))
    assert toxicity.fit(texts, np.array(labels)).thresholds.tolist() == [-1.0] * 4 + [1.0]


def test_toxicity_scores_are_those_of_a_plain_convolution():
    rng = np.random.default_rng(11)
    filters = {w: rng.normal(size=(w, toxicity.DIM, 3)).astype(np.float32) for w in toxicity.WIDTHS} | {w: rng.normal(size=(1, toxicity.DIM, 2)).astype(np.float32) for w in toxicity.WIDE}
    count = sum(f.shape[2] for f in filters.values())
    embed = rng.normal(size=(toxicity.PAD + 1, toxicity.DIM)).astype(np.float32)
    model = toxicity.Model(embed, filters, rng.normal(size=count).astype(np.float32), rng.normal(size=count), 0.3, rng.normal(size=5))
    for words in ([], prose(1, 1), "the of and to".split() + prose(40, 2), "der die das".split() + prose(300, 3)):
        own = toxicity.bins(text.one(" ".join(words), text.ALNUM)) if words else np.zeros(0, np.int32)
        x = np.concatenate((own, np.full(3, toxicity.PAD, np.int32)))
        pooled = []
        for w, f in filters.items():
            places = []
            for at in range(len(x) - 2):
                part = embed[x[at : at + w]].astype(np.float64)
                places.append(sum(part[j] @ f[j if f.shape[0] > 1 else 0] for j in range(len(part))))
            pooled.append(np.max(places, axis=0))
        logit = float(np.maximum(np.concatenate(pooled) + model.bias, 0) @ model.out + model.base)
        found = [sum(v in words for v in known.split()) for known in toxicity.LANGUAGES.values()]
        lang = int(np.argmax(found)) if max(found) else -1
        score, guess = toxicity.scores(model, model.tables(), toxicity.known_bins(), *toxicity.pad(text.one(" ".join(words), text.ALNUM) if words else np.zeros(0, np.uint64), np.array([0, len(words)])))
        assert guess[0] == lang and abs(score[0] - 1 / (1 + math.exp(-min(40, max(-40, logit - model.thresholds[lang]))))) < 1e-4


def test_toxicity_on_held_out_rows_of_the_table(spark):
    """Figures of rows whose labels were never seen, on the larger test table."""
    folder = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if r["toxic"] is not None}
    rows = [(r["score"], labels[r["doc_id"]]) for r in QUERIES["op8_toxicity"](spark, folder).where("held_out").collect() if r["doc_id"] in labels]
    rank = {s: r for r, s in enumerate(sorted({s for s, _ in rows}))}
    toxic, clean = ([rank[s] for s, y in rows if y == v] for v in (1, 0))
    wins = sum((t > c) + 0.5 * (t == c) for t in toxic for c in clean) / (len(toxic) * len(clean))
    right = sum((s >= 0.5) == bool(y) for s, y in rows) / len(rows)
    assert len(rows) > 700 and wins > 0.95 and right > 0.95


def test_toxicity_sample_is_bounded_in_bytes(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels: seen.append([len(t) for t in texts]))
    docs = table(spark, [(i, " ".join(prose(50, i))) for i in range(40)] + [(40, "x " * 5000)])
    labels = table(spark, [(i, i % 2) for i in range(41)], "doc_id long, toxic int")
    toxicity.train(docs, labels)
    whole = len(seen[0])
    monkeypatch.setattr(toxicity, "SAMPLE_TOTAL", 4000)
    toxicity.train(docs, labels)
    assert whole > 25 and 0 < len(seen[1]) < 15


def test_toxicity_rows_and_folds(spark, duck):
    rows = QUERIES["op8_toxicity"](spark, SF).collect()
    assert {r["doc_id"]: r["held_out"] for r in rows} == {d: zlib.crc32(str(d).encode()) % 5 == 0 for d, _ in documents(duck)}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


# 9


def test_token_counts_against_viterbi(spark, duck):
    pieces = tokens.load_vocabulary()

    def count(token):
        data = token.encode()
        best = [(0.0, 0)] + [(-math.inf, 0)] * len(data)
        for end in range(1, len(data) + 1):
            for start in range(end):
                if (p := pieces.get(data[start:end])) is not None:
                    s, n = best[start][0] + p, best[start][1] + 1
                    if s > best[end][0] or s == best[end][0] and n < best[end][1]:
                        best[end] = s, n
        return best[-1][1]

    got = {r["doc_id"]: (r["n_tokens"], r["n_pretokens"]) for r in QUERIES["op9_token_counts"](spark, SF).collect()}
    known = {}
    for d, t in documents(duck)[:60]:
        pre = tokens.PRETOKEN.findall(t or "")
        assert "".join(pre) == (t or "")
        for p in set(pre):
            known.setdefault(p, None)
            known[p] = known[p] or count(p)
        assert got[d] == (sum(known[p] for p in pre), len(pre))


def test_bounds_of_a_task_change_no_count(monkeypatch):
    texts = [" ".join(prose(40, i)) for i in range(30)] + [" ".join(prose(900, 77)), "x" * 2500 + " y", "é" * 700 + "日本" * 500 + " end", "\U0001f600" * 400]
    trie = tokens.Trie(tokens.load_vocabulary())
    monkeypatch.setattr(tokens, "LONG", 10**9)
    whole = [trie.count_text(t) for t in texts]
    assert whole == [(trie.count(tokens.PRETOKEN.findall(t)), len(tokens.PRETOKEN.findall(t))) for t in texts]
    for name, value in (("NODES", 200), ("PIECES", 7), ("LONG", 20)):
        monkeypatch.setattr(tokens, name, value)
    small = tokens.Trie(tokens.load_vocabulary())
    assert [small.count_text(t) for t in texts] == whole and len(small.scores) < 400


# 10


def _cut(docs, window=50):
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in docs}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def test_substring_dedup_against_brute_force(spark, duck):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in QUERIES["op10_substring_dedup"](spark, SF).collect()}
    assert got == {d: (n, g, hashlib.sha256(k.encode()).hexdigest()) for d, (n, g, k) in _cut(documents(duck)).items()}


def test_substring_dedup_of_shifted_and_nested_repeats(spark):
    p, q = prose(80, 1), prose(55, 2)
    docs = [(1, p), (2, [*prose(30, 3), *p[10:75], *prose(5, 4)]), (3, [*q, *q]), (4, [*p, *q]), (5, p[:49]), (6, p[:50]), (7, ["same"] * 120), (8, ["same"] * 60), (9, [*q[:54], "x"]), (10, p[20:] + p[:30])]
    docs = [(d, "\t ".join(w)) for d, w in docs]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring.remove_repeats(table(spark, docs)).collect()}
    assert got == _cut(docs)
    df = table(spark, [(d, t, 1, "x", len(t)) for d, t in docs], "doc_id long, text string, starts int, h string, n_chars long")
    rows = {r["doc_id"]: r for r in substring.without_repeats(df).collect()}
    assert rows[1]["text"] == docs[0][1] and rows[6]["text"] == "" and rows[6]["n_chars"] == 0 and rows[2].asDict().keys() == {"doc_id", "text", "starts", "h", "n_chars"}


def test_doubling_goes_on_until_no_candidates_survive(spark):
    p = prose(450, 21)
    docs = [(1, p), (2, [*prose(20, 22), *p[:210]]), (3, p[100:190]), (4, prose(300, 23)), (5, p[:400]), (6, ["x"] * 500)]
    got = {r["doc_id"]: r["longest"] for r in substring.longest_repeats(table(spark, [(d, " ".join(w)) for d, w in docs])).collect()}
    expected = {}
    for n in (50, 100, 200, 400):
        seen = collections.defaultdict(set)
        for d, w in docs:
            for i in range(len(w) - n + 1):
                seen[tuple(w[i : i + n])].add(d)
        expected |= {d: n for ds in seen.values() if len(ds) > 1 for d in ds}
    assert got == expected == {1: 400, 2: 200, 3: 50, 5: 400}
    assert substring.longest_repeats(table(spark, [(4, "a")])).count() == 0


def test_odd_pages_and_turns(spark, tmp_path):
    pages = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "http://a.com/", "x"), (2, "", None), (3, "http://x.net/es/" + "a" * 100_000, "x")], "page_id long, url string, html string").withColumns({"host": F.lit("h"), "rule": F.lit(1)})
    turns = spark.createDataFrame([(1, 0, None, None, 1), (1, 0, None, None, 1), (None, None, "user", "x" * 50_000, 2), (2, 5, "assistant", "", 3)], "conv_id long, turn long, role string, text string, t int").withColumn("example", F.lit(1))
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for sub, limit in (("full", 9), ("none", 0)):
        folder = str(tmp_path / sub)
        pages.limit(limit).write.parquet(f"{folder}/pages.parquet")
        turns.limit(limit).write.parquet(f"{folder}/conversations.parquet")
        vectors.write.parquet(f"{folder}/embeddings.parquet")
        assert QUERIES["op6_url_filter"](spark, folder).count() == (5 if limit else 0)
        got = {r["conv_id"]: r for r in QUERIES["op2_chat_formatting"](spark, folder).collect()}
        assert set(got) == ({-1, 1, 2, None} if limit else {-1})
        assert not limit or (got[1]["n_turns"], got[None]["n_turns"], got[2]["loss_chars"]) == (2, 1, 0)
        assert QUERIES["op7_exact_top_k"](spark, folder).count() == 0
