"""op11 against both tokenizers run over whole texts, with byte offsets compared one by one."""

import hashlib
from collections import Counter, defaultdict

import pytest
from nearhit.llm import alignment, queries


@pytest.fixture(scope="module")
def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(texts, paths):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(paths[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=paths[1])
    alphabet = alignment.byte_alphabet()
    rows = []
    for t in texts:
        row = {"n_a": 0, "n_b": 0, "n_groups": 0, "links": Counter(), "sha": ""}
        rows.append(row)
        if not t:
            continue
        ea = a.encode(" " + t, add_special_tokens=False)
        ta = [(i, bytes(alphabet[c] for c in x)) for i, x in zip(ea.ids, ea.tokens)]
        tb = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(t)]
        whole = (" " + t).encode()
        if b"".join(x for _, x in ta) != whole or b"".join(x for _, x in tb) != whole:
            continue
        ends = []
        for tokens in (ta, tb):
            at, out = 0, []
            for _, x in tokens:
                at += len(x)
                out.append(at)
            ends.append(out)
        common, names, i, j = sorted(set(ends[0]) & set(ends[1])), [], 0, 0
        for end in common:
            left, right = [], []
            while i < len(ta) and ends[0][i] <= end:
                left.append(ta[i][0])
                i += 1
            while j < len(tb) and ends[1][j] <= end:
                right.append(tb[j][0])
                j += 1
            row["links"].update((x, y) for x in left for y in right)
            names.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
        row.update(n_a=len(ta), n_b=len(tb), n_groups=len(common), sha=hashlib.sha256(";".join(names).encode()).hexdigest())
    count = Counter(p for r in rows for p in r["links"])
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return [(r["n_a"], r["n_b"], r["n_groups"], sum(r["links"].values()), sum(k for p, k in r["links"].items() if count[p] == best[p[0]]),
             sum(k * count[p] for p, k in r["links"].items()), r["sha"]) for r in rows]


def results(df):
    return [tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()]


TRICKY = [None, "", " ", "  a", "a  b ", "a\tb\n c", "x▁y z", "▁", "<|endoftext|> <s> </s>", "it's 'll a  b", "\n\n a b  　 c",
          "banana banana ana", "漢字 かな 🙂🙂 é é ́x", "a\x00b \x1c c", "aaaaaaaaaaaaaaaaaaaaaaaaa " * 3, "    " * 9, "1234567 89,0.5", "a b c", "a b c"]


@pytest.mark.parametrize("hot", [1 << 17, 0])
def test_edge_cases_equal_brute_force(spark, paths, hot):
    rows = [(i if i != 3 else None, t, 1, "x") for i, t in enumerate(TRICKY)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long, pairs string").repartition(3)
    got = sorted(results(alignment.align(docs, *paths, hot=hot)), key=lambda r: -1 if r[0] is None else r[0])
    want = sorted(((r[0], *w) for r, w in zip(rows, brute(TRICKY, paths))), key=lambda r: -1 if r[0] is None else r[0])
    assert got == want


def test_cuts_and_cache_do_not_change_results(spark, paths):
    texts = [" ".join(TRICKY[i % len(TRICKY)] or "" for i in range(k, k + 6)) for k in range(40)]
    units = alignment.Units(alignment.Vocabularies.of(*paths), most=5)  # the cache starts anew for each lot
    want = brute(texts, paths)
    got = []
    for a in range(0, len(texts), 7):
        out = units.lot(texts[a:a + 7])
        got += list(zip(*(c.to_pylist() for c in out[:5])))
    assert [(r[0], r[1], r[2], r[3], r[4]) for r in got] == [(w[0], w[1], w[2], w[3], w[6]) for w in want]


def test_query_equals_brute_force(spark, paths):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: w for r, w in zip(docs, brute([r["text"] for r in docs], paths))}
    got = results(queries.QUERIES["op11_align"](spark, sf))
    assert len(got) == len(docs) and all(want[r[0]] == r[1:] for r in got)


def test_empty_table(spark, paths):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(docs, *paths).collect() == []
