"""Near duplicates, top-k search, packing, personal data, secrets and the pipeline against brute force."""

import random
import re

import numpy as np
import public_tokenizers
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from duelbook.llm import hamming_topk, packing, pii, queries, secret_scan, simhash
from duelbook.llm.components import components

SMALL = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def classes(prints):
    """Smallest index reachable over pairs within two bits."""
    label = list(range(len(prints)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((top(i), top(j)))
                label[b] = a
    return [top(i) for i in range(len(prints))]


def test_near_duplicates_against_all_pairs(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    odd = [(10_001, None), (10_002, ""), (10_003, " \n"), (10_004, "One"), (10_005, "one two"), (10_006, "ONE two"), (10_007, "é x\x1cy z")]
    data = sorted([(r.doc_id, r.text) for r in rows] + odd)
    want = {}
    prints = [plain_fingerprint(t or "") for _, t in data]
    for (doc, _), p, c in zip(data, prints, classes(prints)):
        want[doc] = (f"{p:016x}", data[c][0])
    for crowd in (512, 1):  # with a crowd of 1 every shared cell goes through the finest table
        got = simhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), crowd=crowd)
        assert {r.doc_id: (r.fingerprint, r.component_id) for r in got.collect()} == want


def test_links_in_a_dense_group(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    prints = sorted({base ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 5))) & (1 << 64) - 1 for _ in range(150)} | {rng.getrandbits(64) for _ in range(50)})
    want = classes(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    for crowd in (512, 8, 1):
        found = {r.node: r.label for r in components(simhash.links(spark.createDataFrame([(s,) for s in signed], "bits long"), crowd=crowd)).collect()}
        got = [found.get(s, s) for s in signed]
        assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(len(got)) for j in range(i))


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 8)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100 + k: 100 for k in range(30)}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_keep_one(spark):
    rows = [(3, "a b c d", "x"), (1, "a b c d", "y"), (1, "a b c d", "y"), (None, "q r s t", "z"), (None, "q r s t", "z"), (5, "other words here now", None), (2, None, "n"), (9, "", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _place string")
    out = simhash.keep_one(docs)
    assert sorted([(r.doc_id, r.text) for r in out.collect()], key=str) == sorted([(1, "a b c d"), (None, "q r s t"), (5, "other words here now"), (2, None)], key=str)
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_top_k_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    vectors = [rng.normal(size=32).tolist() for _ in range(120)]
    vectors[50:90] = [vectors[50]] * 40
    rows = [(i, v) for i, v in enumerate(vectors)] + [(7, vectors[7]), (200, None), (201, [None] * 32)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    code = {i: [x is not None and x > 0 for x in v] for i, v in rows if v is not None}
    every = sorted(i for i, v in rows if v is not None)
    asked = table.where("vec_id % 20 = 0").where("vec_id < 190")
    got = {}
    for r in hamming_topk.top_k(table, asked, k=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.distance, r.neighbor_id))
    for q in range(0, 120, 20):
        want = sorted((sum(a != b for a, b in zip(code[q], code[i])), i) for i in every)[:5]
        assert [(d, i) for _, d, i in sorted(got[q])] == want
    few = hamming_topk.top_k(table.where("vec_id < 3"), table.where("vec_id = 0"), k=5)
    assert few.count() == 3
    assert hamming_topk.top_k(table.limit(0), table.limit(0)).count() == 0


def test_packing_whole_ids_and_padding(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    exact = Tokenizer.from_file(path)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows += [(50_001, None), (50_002, ""), (50_003, "it's  don't́ İX a\x1cb. <|endoftext|> É,!!"), (None, "x y"), (50_004, "w " * 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = packing.pack(docs, path, most_open=20).toPandas()
    want = {d: exact.encode(t or "", add_special_tokens=False).ids + [1] for d, t in rows}
    key = got.doc_id.map(lambda d: None if d != d else int(d))
    for d, ids in want.items():
        own = got[key.isna()] if d is None else got[key == d]
        own = own.sort_values("start")
        assert np.concatenate([np.frombuffer(x, "<u4") for x in own.ids]).tolist() == ids
        assert own.start.tolist() == np.cumsum([0, *own.length])[:-1].tolist() and set(own.doc_tokens) == {len(ids)}
    for _, held in got.sort_values("offset").groupby("sequence_id"):
        assert held.offset.tolist() == np.cumsum([0, *held.length])[:-1].tolist()
        assert held.length.sum() <= 2048 and held.length.sum() & (held.length.sum() - 1) == 0
    assert packing.pack(docs.limit(0), path).count() == 0


def test_packing_encodes_a_word_once_whatever_signs_follow(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    exact = Tokenizer.from_file(path)
    texts = ["left out", "Thebler thebler, thebler&&& thebler,*** THEBLER.###", None, "", " \n", "chßé! chßé?% 48.5. 48.5", "it's it's, 'tis x' <|endoftext|>. Y<|",
             "c\u0327\u030c. — —. İ. Σ, a\x1cb.\xa0. 中. ×. ÷! É! \ufb01."]
    sliced = pa.array(texts).slice(1)
    want = [np.array(exact.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts[1:]]
    ids = packing.Ids(path)
    seen = []
    encode_plain = ids.encode_plain
    ids.encode_plain = lambda words: seen.extend(words) or encode_plain(words)
    assert ids.of(sliced) == want and ids.of(sliced) == want
    assert seen.count(b"thebler") == 1 and seen.count("chßé".encode()) == 1
    assert not any(p.startswith(b"thebler") for p in ids.known.to_pylist() if p != b"thebler")
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    for at in (0, 3, 1, 0):
        assert ids.of(sliced.slice(at, 2)) == want[at:at + 2]
        assert len(ids.known) == len(ids.ids) == len(ids.used)
    odd = pa.array([b"a\xc3. \xa9! \xff.", b"b\xc3\xa9."]).view(pa.string())
    assert ids.of(odd) == [np.array(exact.encode(b.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes() for b in odd.cast(pa.binary()).to_pylist()]


def test_level_choice_is_the_smallest_sum_of_squares():
    rng, levels = random.Random(4), packing.Levels(32)
    for _ in range(400):
        size = rng.randint(1, 31)
        before = levels.counts.copy()
        best = []
        for level in range(0, 33 - size):
            if level and not before[level]:
                continue
            after = before.copy()
            after[level] -= 1 if level else 0
            if level + size < 32:
                after[level + size] += 1
            best.append((int((after ** 2).sum()), -level))
        assert levels.level_for(size) == -min(best)[1]
        levels.place((0, 0, b"\0" * 4 * size, size))


PII = [
    (1, "Mail Bob.Smith99@Mail.example.com or bob.smith99@mail.example.com; JANE@MAIL.EXAMPLE.COM."),
    (2, "call +1 (017) 555-7713, +1 017 555 7713 or (212) 555-0100"),
    (3, "card 4111 1111 1111 1111, 4111-1111-1111-1111, not 4111111111111112"),
    (4, "DE89 3704 0044 0532 0130 00 and 83.229.25.121 and 999.1.1.1"),
    (5, "Mr. John Miller met Frau Schmidt, Sarah Schmidt and Елена Петрова"),
    (6, "123-45-6789 fe80::1:2 2024-01-02 12:30:45 version 1.2.3"), (7, None), (8, ""), (9, "nothing here, just Words"), (1, "bob.smith99@mail.example.com"),
]


def test_surrogates(spark):
    docs = spark.createDataFrame(PII, "doc_id long, text string").withColumn("n_pii", F.lit("old")).withColumn("extra", F.lit(1))
    out = [(r.doc_id, r.text, r.n_pii) for r in pii.pseudonymise(docs, "k").collect()]
    got = {d: t for d, t, n in out if not (d == 1 and n == 1)}
    a = re.findall(r"\S+@\S+(?=[ ;.])", got[1])
    assert a[0] == a[1].rstrip(";") and "@" in a[2] and a[2].rstrip(".").isupper() and "bob" not in got[1].lower()
    assert a[0].split("@")[1] == a[2].rstrip(".").split("@")[1].lower()
    assert re.fullmatch(r"[a-z]{3}\.[a-z]{5}\d\d@[a-z]{4}\.[a-z]{7}\.com", a[0])
    assert [t for d, t, n in out if d == 1 and n == 1] == [a[0]]
    phones = re.fullmatch(r"call \+1 \((\d{3})\) (\d{3})-(\d{4}), \+1 (\d{3}) (\d{3}) (\d{4}) or \(\d{3}\) \d{3}-\d{4}", got[2])
    assert phones and phones.groups()[:3] == phones.groups()[3:] and "5557713" not in re.sub(r"\D", "", got[2])
    cards = re.findall(r"4\d{3}[ -]\d{4}[ -]\d{4}[ -]\d{4}", got[3])
    digits = [re.sub(r"\D", "", c) for c in cards]
    luhn = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits[0])))
    assert len(cards) == 2 and digits[0] == digits[1] != "4111111111111111" and luhn % 10 == 0 and got[3].endswith("not 4111111111111112")
    iban = re.search(r"DE\d\d(?: \d{4}){4} \d\d", got[4])[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and "83.229" not in got[4] and got[4].endswith("999.1.1.1")
    male, female, woman, russian = re.fullmatch(r"Mr\. (\w+) \w+ met Frau (\w+), (\w+ \w+) and (\w+) \w+", got[5]).groups()
    assert male in pii.GIVEN["latin", "m"] and woman.split()[0] in pii.GIVEN["latin", "f"] and woman.split()[1] == female and russian in pii.GIVEN["cyrillic", "f"]
    assert re.fullmatch(r"\d{3}-\d\d-\d{4} [0-9a-f]{4}::[0-9a-f]:[0-9a-f] 2024-01-02 12:30:45 version 1\.2\.3", got[6]) and "123-45" not in got[6]
    assert got[7] is None and got[8] == "" and got[9] == PII[8][1]
    assert {r.text for r in pii.pseudonymise(docs, "other").where("doc_id = 2").collect()} != {got[2]}
    assert pii.pseudonymise(docs.limit(0), "k").count() == 0


def test_surrogates_are_distinct_in_a_small_domain(spark):
    # one letter before the sign: 26 addresses of one domain fight for 26 surrogates
    docs = spark.createDataFrame([(k, f"{chr(97 + k)}@x.com") for k in range(26)], "doc_id long, text string")
    out = [r.text for r in pii.pseudonymise(docs, "k").collect()]
    assert len(set(out)) == 26 and not set(out) & {f"{chr(97 + k)}@x.com" for k in range(26)}


def plain_base(text):
    word = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
    rules = [(rf"""({word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8), (r"AKIA[A-Z0-9]+", 0, 16), (r"[0-9a-f]+", 0, 32)]
    found = [(m.start(), k, m.end()) for k, (p, g, n) in enumerate(rules) for m in re.finditer(p, text) if len(m[g]) >= n]
    return ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_secret_base_against_plain_matching(spark):
    rng = random.Random(8)
    bits = ["token", "=", ":", " ", "'", '"', "apiKEY", "api_key", "Secret", "abcdefgh", "AKIA", "ABCDEFGH0123", "deadbeef" * 4, "f", "é", "🙂", "\n", "ſecret", "passwd", "-x"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for k in range(500)] + [(900, None), (901, "")]
    got = secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(0))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.base_spans == plain_base(r.text or "")
        assert r.n_assign + r.n_access + r.n_hex == (r.base_spans.count(":") // 2)


def test_weak_parts_need_their_complement(spark):
    key = "aB3" + "dEfGhIjKl+/0" * 3 + "Q"
    cases = {
        "user=bob password: hunter2222 https://x.y/z": "ident:0:8,assign:9:29,endpoint:30:43", "https://a.b/c alone": "", "user: bob": "",
        "user: bob\n\nsecret=abcdefgh": "assign:11:26", f"user=bob {'x' * 4000} secret=abcdefgh": "ident:0:8,assign:4010:4025",
        f"client_id = abc123 {key}": "ident:0:18,key:19:59", key: "", f"https://db.x {key}": "endpoint:0:12,key:13:53",
    }
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id int, text string")
    assert {r.text: r.spans for r in secret_scan.scan(docs).collect()} == cases
    assert secret_scan.scan(docs.limit(0)).count() == 0


def test_pipeline_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = docs.columns
    passage = spark.read.parquet(f"{SMALL}/benchmark.parquet").first()["text"]
    extra = [(90_001, f"Before. {passage} After the end of it.", "en", "s", 1), (90_002, None, None, None, None), (90_003, "12 34", "en", "s", 5),
             (90_004, f"write to some.one@mail.example.org about {' '.join(f'the{k} thing' for k in range(30))}", None, "s", 1)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        out.write.parquet(f"{tmp_path}/{k}")
        last, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == names
        if k == 0:
            kept = {r.doc_id: r for r in docs.collect()}
            assert len(kept) == last.count() - 2 and 90_002 not in kept and 90_003 not in kept and kept[90_004].lang == "en"
        if k == 1:
            prints = {r.doc_id: (plain_fingerprint(r.text)) for r in last.collect()}
            ids = sorted(prints)
            assert {r.doc_id for r in docs.collect()} == {ids[c] for c in classes([prints[i] for i in ids])}
        if k == 2:
            row = docs.where("doc_id = 90001").first()
            assert row.text.startswith("Before.") and "After the end" in row.text and passage not in row.text and row.n_chars == len(row.text)
            assert docs.count() == last.count()
        if k == 3:
            assert docs.where("text like '%@mail%.example.%'").count() == 0 and docs.count() == last.count()
    assert docs.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("d")).where("n <> d").count() == 0
    assert docs.select("doc_id").distinct().count() == last.count()


def test_every_operator_is_registered():
    names = sorted(queries.REGISTRY, key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(names)


def test_queries_match_duckdb(spark):
    from check import compare, duck

    for name, statement in queries.ORACLE_SQL.items():
        assert compare(name, queries.REGISTRY[name](spark, SMALL), duck(SMALL), statement) is None


def test_very_long_texts(spark):
    filler = " ".join(f"word{k % 977}" for k in range(60_000))
    text = f"{filler} mail long.text@mail.example.org token = 'abcdefgh1234' {filler}\n" + "x" * 200_000 + " a." * 50_000
    docs = spark.createDataFrame([(1, text), (2, text), (3, "short one")], "doc_id long, text string")
    out = {r.doc_id: r for r in pii.pseudonymise(docs, "k").collect()}
    assert out[1].n_pii == 1 and "long.text@" not in out[1].text and out[1].text == out[2].text and len(out[1].text) == len(text)
    found = {r.doc_id: r for r in secret_scan.scan(docs).collect()}
    start = text.index("token")
    assert found[1].spans == f"assign:{start}:{start + 21}" and found[3].spans == ""
    prints = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert prints[1].fingerprint == f"{plain_fingerprint(text):016x}" and prints[2].component_id == 1


def test_queries_on_empty_and_null_tables(spark, tmp_path):
    for name in ("documents", "pages", "benchmark", "conversations", "embeddings"):
        table = spark.read.parquet(f"{SMALL}/{name}.parquet")
        table.limit(0).write.parquet(f"{tmp_path}/empty/{name}.parquet")
        spark.createDataFrame([(None,) * len(table.columns)] * 2, table.schema).write.parquet(f"{tmp_path}/null/{name}.parquet")
    for name, fn in queries.REGISTRY.items():
        assert len(fn(spark, f"{tmp_path}/empty").collect()) == (name == "op4_chat"), name
        # two rows of nulls: each is reported, but for conversations (one) and vectors (no codes)
        expected = {"op4_chat": 2, "op7_hamming_topk": 0, "op11_lsh_search": 0}.get(name, 2)
        assert len(fn(spark, f"{tmp_path}/null").collect()) == expected, name
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == corpus_pipeline.run(spark, f"{tmp_path}/null").count() == 0


def test_surrogates_do_not_run_out(spark):
    # more one-word names than three syllables give, every address of the form x::y, and a full private network
    cons, vowels = "bcdfghjklmnprstvwz", "aeiou"
    names = [f"Mr {a.upper()}{b}{c}{d}q" for a in cons for b in vowels for c in cons for d in cons][:17000]
    six = [f"{a:x}::{b:x}" for a in range(16) for b in range(16)]
    four = [f"192.168.{a}.{b}" for a in range(256) for b in range(256)]
    values = names + six + four
    docs = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "doc_id int, text string")
    got = {r.doc_id: (r.text, r.n_pii) for r in pii.pseudonymise(docs, "k").collect()}
    assert len(got) == len(values) and {n for _, n in got.values()} == {1}
    assert len({t for t, _ in got.values()}) == len(set(values)) and not {t.lower() for t, _ in got.values()} & {v.lower() for v in values}


def test_failed_checks_use_up_no_text(spark):
    spain, belgium, card = "ES91 2100 0418 4502 0005 1332", "BE68 5390 0754 7034", "4111 1111 1111 1111"
    cases = {
        f"{spain} BIC CAIXESBB": (spain, " BIC CAIXESBB"), f"a {spain.replace(' ', '')} BIC": (spain.replace(" ", ""), " BIC"),
        f"pay {belgium} EUR 5": (belgium, " EUR 5"), f"ID12 {card}": (card, "ID12 "), f"1234 5678 9012 {card}.": (card, "1234 5678 9012 "),
        f"{spain} {card} x": (spain, " x"), f"Tel +49 30 123456 {card} y": (card, " y"), "+49 30 12345678 1234 5678 1234 z": ("+49 30 12345678", " z"),
        "+4930123456789012345 k": ("", "+4930123456789012345 k"), f"DE00 {card} {spain}": (spain, "DE00 "),
    }
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id int, text string")
    got = {r.doc_id: (r.text, r.n_pii) for r in pii.pseudonymise(docs, "k").collect()}
    for k, (source, (gone, stays)) in enumerate(cases.items()):
        text, n = got[k]
        assert (not gone or gone not in text and n >= 1) and stays in text and len(text) == len(source), (source, text, n)
    assert got[5][1] == 2 and card not in got[5][0] and got[6][1] == 2 and "30 123456 " not in got[6][0] and got[9][1] == 2 and card not in got[9][0]


def test_secret_parts_are_linked_at_any_distance_in_a_scope(spark):
    key, address = "aB3" + "x" * 37, "https://db.x/" + "p" * 400
    docs = spark.createDataFrame([(1, f"{address} {key}"), (2, f"{key} {address} user=bob"), (3, f"{key} {'x' * 301} user=bob"), (4, f"{key}\n \nuser=bob")], "doc_id int, text string")
    got = {r.doc_id: r.spans for r in secret_scan.scan(docs).collect()}
    n = len(address)
    assert got == {1: f"endpoint:0:{n},key:{n + 1}:{n + 41}", 2: f"key:0:40,endpoint:41:{n + 41},ident:{n + 42}:{n + 50}", 3: "key:0:40,ident:343:351", 4: ""}
