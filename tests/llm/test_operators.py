"""Every operator against a plain version, on fixtures with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, decontaminate, html_text, language, ngram_join, pieces, pseudonyms, quality, suffix_dedup, token_file, topk

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
A = "the quick brown fox jumps over the lazy dog and runs into the deep green forest"
B = "a completely different sentence about ships and harbours with many other words in it"


def docs(spark, rows):
    """documents with columns whose names clash with those the operators use inside."""
    table = [(i, t, "en", "s", len(t or ""), 1, 2, "x") for i, t in rows]
    return spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long, grp int, n int, component string")


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


ROWS = [(1, A), (2, A + " " + B), (3, A), (4, None), (5, ""), (6, "x"), (7, B + "\n" + A + " éàü 漢字"), (8, "Ha " * 400), (9, "Ha " * 380), (10, "word " * 20_000), (10, A), (None, A), (12, B * 3)]


# --- 1 ---------------------------------------------------------------------------------------------------------


def brute_repeats(rows):
    big = 2**63
    order = sorted(range(len(rows)), key=lambda i: big if rows[i][0] is None else rows[i][0])
    first = {}
    for i in order:
        b, key = (rows[i][1] or "").encode(), big if rows[i][0] is None else rows[i][0]
        for s in range(len(b) - 49):
            first.setdefault(b[s : s + 50], key)
    out = []
    for d, t in rows:
        b, key = (t or "").encode(), big if d is None else d
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < key:
                gone[s : s + 50] = b"\1" * 50
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("many", [500, 1])
def test_repeats(spark, monkeypatch, many):
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 256)
    got = suffix_dedup.remove_repeats(docs(spark, ROWS))
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(ROWS)


def test_repeats_empty(spark):
    assert suffix_dedup.remove_repeats(docs(spark, [(1, "a")]).where("false")).count() == 0


def test_suffix_order_sorts():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 600).astype(np.uint8)
    start = np.arange(0, 500, 5)
    group = np.repeat(np.arange(4), 25)
    order = suffix_dedup.suffix_order(data, common.prefix_hash(data), start, group)
    raw = data.tobytes()
    want = sorted(range(100), key=lambda i: (group[i], raw[start[i] : start[i] + 50], i))
    assert order.tolist() == want


# --- 2 ---------------------------------------------------------------------------------------------------------


def test_token_file(spark):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = [(5, "Hello, it's <|endoftext|> a Test!\tİstanbul x 12.5"), (3, None), (9, ""), (1, "é́ word " * 3000), (7, "a\n\nb  c"), (7, "a\n\nb  c")]
    folder = common.fresh_path(spark, "test-tokens")
    shards = token_file.write(docs(spark, texts), path, folder, length=16, rows=4)
    got = rows_of(token_file.read(spark, shards, folder), "doc_id", "start", "n_tokens", "ids_crc32")
    want, start = [], 0
    for d, x in sorted(texts, key=lambda r: r[0]):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == sorted(want, key=str)


def test_sequence_at(spark):
    folder = common.fresh_path(spark, "test-tokens")
    token_file.write(docs(spark, [(1, "a b c d e f g h i j k l m n o p q r s t")]), P.path("word_bpe_49k.json"), folder, length=8, rows=1).collect()
    import glob

    path = glob.glob(folder.removeprefix("file://") + "/ids-*.arrows")[0]
    ids, mask = token_file.sequence_at(path, 2)
    assert len(ids) == 8 and mask.tolist() == [True] * 5 + [False] * 3 and ids[4] == 2


# --- 3 ---------------------------------------------------------------------------------------------------------


def test_pieces_equal_the_library(spark):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    m, v = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Vocabulary(path)
    texts = [*ROWS, (20, "  two  blanks   and\n\ttabs ☃😀 "), (21, "x" * 500 + "y" * 77), (22, "\0 nul"), (23, " ")]
    got = rows_of(pieces.encode(docs(spark, texts), v), "doc_id", "n_pieces", "ids_crc32", "round_trip")
    want = []
    for d, x in texts:
        ids = np.array(m.encode(x or ""), "<u4")
        want.append((d, len(ids), zlib.crc32(ids.tobytes()), True))
    assert got == sorted(want, key=str)
    full = pieces.encode(docs(spark, texts), v)
    back = pieces.decode(full, v)
    assert rows_of(back, "doc_id", "text") == sorted(((d, x or "") for d, x in texts), key=str)


def test_viterbi_fold(spark):
    v = pieces.Vocabulary(P.path("piece_bpe_32k.model"))
    v.kind = pieces.UNIGRAM
    v._fill([("<unk>", 0, 2), ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("ab", -3.0, 1), ("▁a", -2.5, 1), ("ba", -3.5, 1), ("▁ab", -6.5, 1)])
    words = ["▁ab", "▁aba", "b", "▁abab", "xa", "▁"]
    atoms = spark.createDataFrame([(w,) for w in words], "atom string")
    got = {r["atom"]: list(r["ids"]) for r in pieces.lattice(atoms, v).collect()}
    assert got == {w: v.best_path(w) for w in words}


# --- 4 ---------------------------------------------------------------------------------------------------------


def brute_topk(rows, k):
    ok = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    out = []
    for q, a in ok:
        if q % 20 == 0:
            best = sorted((-int(a @ b), i) for i, b in ok if i != q and len(b) == len(a))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out, key=str)


def test_topk(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 30)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=6) + (i % 3)).astype(np.float32).tolist()) for i in range(200)]
    rows += [(i, rows[5][1]) for i in range(200, 230)] + [(300, None), (301, []), (302, [1.0, None]), (303, [float("nan")] * 6), (320, [1.0, 2.0]), (340, [2.0, 2.0]), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, cell int, part int")
    assert rows_of(topk.top_k(df, k=7), "query_id", "rank", "vec_id", "score") == brute_topk(rows, 7)
    assert topk.top_k(df.where("false")).count() == 0


def test_topk_of_large_components(spark):
    rows = [(0, [1.0, 4e7]), (1, [2.0, 3.0]), (2, [-5e7, 1e8]), (20, [3e18, 1.0]), (21, [1e300, -1e300]), (22, [float("nan"), 1.0]), (23, None), (24, [None, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3).collect()
    whole = {i: [max(-(2**63), min(2**63 - 1024, int(np.floor(64 * x)))) for x in v] for i, v in rows if i < 22}
    for q in (0, 20):
        want = sorted(((max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(whole[q], v)))), i) for i, v in whole.items() if i != q), key=lambda t: (-t[0], t[1]))[:3]
        assert [(r["score"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == want


# --- 5 ---------------------------------------------------------------------------------------------------------


def test_pseudonyms_keep_formats_and_links():
    text = "Mail bob.o'x@mail.example.co.uk or call +1 (826) 555-4081 225.209.237.237, card 4111 1111 1111 1111, ssn 078-05-1120, GB82 WEST 1234 5698 7654 32, 2021-03-04, token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\""
    new, found = pseudonyms.rewritten(text)
    assert [f[2] for f in found] == ["email", "phone", "ip", "card", "ssn", "iban", "date", "secret"]
    again, _ = pseudonyms.rewritten("x 4111-1111-1111-1111 y 225.209.237.237.")
    digits = lambda s, p: re.sub(r"\D", "", re.search(p, s)[0])
    card = digits(new, r"card [\d ]+")
    assert card == digits(again, r"[\d-]{19}") and pseudonyms.luhn_digit(card[:-1]) == card[-1] and card != "4" + "1" * 15
    assert new.split("4081")[0] != text.split("4081")[0] and re.search(r"\+1 \(\d{3}\) \d{3}-\d{4} \d+\.\d+\.\d+\.\d+,", new)
    assert pseudonyms._remainder(re.search(r"GB[\w ]+", new)[0].strip().replace(" ", "")) == 1
    assert re.search(r'"[0-9a-f]{40}"', new)


@pytest.mark.parametrize("text", ["version 1.2.3.4.5 and 300.1.1.1", "1234567890123456", "2021-13-45 at 12:30", "nothing here", "a@b", "000-12-3456"])
def test_what_is_not_valid_stays(text):
    assert pseudonyms.rewritten(text)[0] == text


def test_feistel_is_a_bijection():
    seen = {tuple(pseudonyms.feistel([a, b, c], [10, 10, 10], b"k", "t")) for a in range(10) for b in range(10) for c in range(10)}
    assert len(seen) == 1000
    dates = {pseudonyms._date(f"20{y:02d}-{m:02d}-15", b"k") for y in range(30) for m in range(1, 13)}
    assert len(dates) == 360


def test_pseudonymise_table(spark):
    got = pseudonyms.pseudonymise(docs(spark, [(1, None), (2, ""), (None, "ip 10.1.2.3"), (2, "ip 10.1.2.3")]), counts=True)
    assert got.columns[:8] == docs(spark, ROWS).columns and sum(r["n_ip"] for r in got.collect()) == 2
    assert len({r["text"] for r in got.collect() if r["n_ip"]}) == 1


# --- 6, 7 ------------------------------------------------------------------------------------------------------


def test_language_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in language.query(spark, "/root/testdata/sf0.01").collect()}
    apart = [r for r in d.select("doc_id", "lang").collect() if got[r["doc_id"]]["held_out"]]
    assert len(apart) > 200 and sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in apart) >= 0.97 * len(apart)
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in apart)


def test_language_edges(spark):
    rows = docs(spark, [(1, None), (2, "12 ??"), (3, ""), (4, A), (None, A)])
    models = language.Models({"en": [A, A + " " + A], "xx": ["zorp blik zzz qqq " * 5]})
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(rows, models).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == got[None][0] == "en"
    assert {r["lang_pred"] for r in language.identify(rows, None).collect()} == {"und"}


def test_kneser_ney_sums_to_one():
    m = language.Models({"en": [A, B]}, order=3)
    chars, off, _ = language.letters([A])
    seen = np.unique(np.concatenate([language.letters([A, B])[0], [np.uint64(ord("é"))]]))
    context = chars[:5]
    total = 0.0
    for c in seen[seen != ord("é")]:
        x = np.append(context, c)
        o = np.array([0, len(x)])
        total += np.exp(m._at(3, language.grams(x, o, 3), language.contexts(x, o, 3))[-1, 0])
    assert 0.95 < total <= 1.0001  # the rest is what unseen characters get


def test_quality_held_out(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    got = [r for r in quality.query(spark, "/root/testdata/sf0.1").collect() if r["held_out"] and labels.get(r["doc_id"]) is not None]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in got) >= 0.96 * len(got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_quality_keeps_rows_with_clashing_columns(spark):
    texts = [(i, (A if i % 2 else "@@ $$ !! " * 9) + f" {i}") for i in range(120)]
    d = docs(spark, texts).withColumn("predicted", F.lit(7)).withColumn("_h", F.lit(1)).withColumn("y", F.lit(3))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(120)] + [(3, 0, 0)], "doc_id long, quality int, toxic int")
    kept = quality.score(d, quality.fit(d, labels), keep=True)
    assert kept.columns == d.columns and [r["doc_id"] for r in kept.orderBy("doc_id").collect()] == list(range(1, 120, 2))
    again = [quality.score(d, quality.fit(d.repartition(n), labels)).orderBy("doc_id").collect() for n in (1, 3)]
    assert again[0] == again[1]
    assert quality.score(d.where("false"), quality.Quality()).count() == 0


def test_language_rejection(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    models = language.fit(d)
    rows = docs(spark, [(1, "qqzx xkqj vvzzq jjqxz wqkzx zzqjq xqxqz kkqzj vqxzj"), (2, d.where("lang = 'en'").first()["text"])])
    assert {r["doc_id"]: r["lang_pred"] for r in language.identify(rows, models, reject=True).collect()} == {1: "und", 2: "en"}
    assert {r["lang_pred"] == "und" for r in language.identify(rows, models).collect()} == {False}


def test_quality_without_labels(spark):
    d = docs(spark, [(1, None), (2, ""), (3, A)])
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit(d, empty)
    assert {r["score"] for r in quality.score(d, model).collect()} == {0.5}


# --- 8 ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<nav><a href=x>menu</a></nav>", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<article><h1>T</h1><p>a<br>b&nbsp; c<p>d</article><footer>f</footer>", "T\na b c\nd"),
        ("<body><div id=nav><a href=x>Home</a> <a href=y>About</a></div><div id=content><h1>Title</h1><p>Long text of the article with <a href=q>a link</a> and more words.<p>Second paragraph is long enough too.</div><div class='comments'><p>I disagree with this text for many reasons.</div><div id=footer>(c)</div>", "Title\nLong text of the article with a link and more words.\nSecond paragraph is long enough too."),
        ("<main><script>var t='</p>';</script><style>p{}</style><p>Only this</p><form><p>Sign up</p></form><aside>x</aside></main>", "Only this"),
        ("<article><p>unclosed <b>bold <i>both</b> end<!-- no --></p><table><tr><td>1<td>2<tr><td>3</table>", "unclosed bold both end\n1 2\n3"),
        ("<article><p>cut off in the mid", "cut off in the mid"),
    ],
)
def test_main_text(page, text):
    assert html_text.extract(page) == text


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", "<p>é</p>", 5), (None, None, None, 5), (1, "u", "<p>é</p>", 5)], "page_id long, url string, html string, text int")
    assert rows_of(html_text.main_text(df), "page_id", "url", "text", "n_chars") == [(1, "u", "é", 1), (1, "u", "é", 1), (None, None, "", 0)]


# --- 9 ---------------------------------------------------------------------------------------------------------


def test_decontaminate(spark):
    long = "w%d " * 0 + " ".join(f"w{i}" for i in range(3000))
    item = " ".join(f"w{i}" for i in range(1500, 1540))
    partly = " ".join(f"w{i}" for i in range(1500, 1530)) + " other words stand here"
    d = docs(spark, [(1, long), (2, partly), (3, None), (4, ""), (5, "short test"), (6, "A Short  TEST item"), (7, item.upper()), (None, item)])
    items = spark.createDataFrame([(10, item, 1), (11, "short test", 1), (12, None, 1), (13, " ", 1), (14, "nowhere to be found at all", 1)], "item_id long, text string, doc_id int")
    got = rows_of(decontaminate.contained(d, items), "doc_id", "item_id")
    assert got == sorted([(1, 10), (7, 10), (None, 10), (5, 11), (6, 11)], key=str)
    assert sorted(x["doc_id"] for x in decontaminate.clean(d, items).collect()) == [2, 3, 4]
    assert decontaminate.contained(d, items.where("false")).count() == 0


# --- 10 --------------------------------------------------------------------------------------------------------


def brute_classes(rows, words, threshold):
    split = re.compile(r"[^\x20\x09-\x0D]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, t in rows:
        w = split.findall((t or "").translate(lower))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    up = {d: d for d, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= threshold * len(a | b):
                x, y = sorted((find(rows[i][0]), find(rows[j][0])))
                up[y] = x
    return sorted(((d, len(s), None if d is None else find(d)) for (d, _), s in zip(rows, sets)), key=str)


@pytest.mark.parametrize(("words", "threshold", "many"), [(4, 85, 1000), (5, 80, 2)])
def test_ngram_join(spark, monkeypatch, words, threshold, many):
    monkeypatch.setattr(ngram_join, "MANY", many)
    monkeypatch.setattr(ngram_join, "GROUP_BYTES", 4096)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 400, 150)]
    line = " ".join(f"common{i}" for i in range(30))
    rows = [(i, t) for i, t in ROWS if i not in (10, None)]
    for i in range(100, 160):
        w = list(base)
        for at in rng.integers(0, 150, rng.integers(0, 8)):
            w[at] = f"x{rng.integers(0, 9999)}"
        rows.append((i, " ".join(w[: 150 - int(rng.integers(0, 12))])))
    rows += [(i, line + " " + " ".join(f"u{i}_{k}" for k in range(40))) for i in range(200, 240)]
    rows += [(300, "One two"), (301, "one  TWO"), (302, "one"), (303, " \n")]
    got = ngram_join.join(docs(spark, rows), words=words, threshold=threshold)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == brute_classes(rows, words, threshold)


def test_ngram_join_nulls_and_empty(spark):
    d = docs(spark, [(None, A), (1, A), (2, None)])
    assert rows_of(ngram_join.join(d), "doc_id", "component_id") == sorted([(None, None), (1, 1), (2, 2)], key=str)
    assert ngram_join.join(d.where("false")).count() == 0


# --- all -------------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline

    d = spark.read.parquet(f"{SF}/documents.parquet")
    kept, sizes = d, [d.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = common.written(stage(spark, kept, SF), "test-stage")
        assert kept.columns == d.columns, name
        sizes.append(kept.count())
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] == sizes[4] > 0.5 * sizes[0]
    out = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert out.count() == sizes[-1] and out.where("NOT round_trip").count() == 0
    texts = Counter(r["text"] for r in kept.collect())
    assert max(texts.values()) == 1
    assert not any(re.search(r"@mail\d\.example\.com", t) and pseudonyms.rewritten(t)[0] == t for t in texts)
