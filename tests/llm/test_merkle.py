import hashlib
import zlib

import duckdb

from reelproof.llm import merkle, queries


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def part(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(doc_id, source, lang, n_chars, text):
    return sha("".join(map(part, (doc_id, source, lang, n_chars, text))))


def levels_of(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [sha("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
        out.append(nodes)
    return out


def brute(rows):
    """rows (doc_id, source, lang, n_chars, text) from the definition, one proof at a time."""
    first = lambda x: (x is not None, x)
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((first(r[0]), leaf_of(*r), r))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: levels_of([x[1] for x in sorted(groups[g], key=lambda x: (x[0], x[1]))]) for g in langs}
    top = levels_of([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for i, (_, leaf, r) in enumerate(sorted(groups[g], key=lambda x: (x[0], x[1]))):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            fold, proof = leaf_of(*r[:3], r[3] + 1, r[4]) if hit else leaf, ""
            for tree, at in ((trees[g], i), (top, k)):
                for level in tree[:-1]:
                    pair = level[at // 2 * 2 : at // 2 * 2 + 2]
                    proof += "".join(x for j, x in enumerate(pair) if j != at % 2)
                    pair[at % 2] = fold
                    fold, at = sha("".join(pair)), at // 2
            out.append((r[0], leaf, trees[g][-1][0], top[-1][0], sha(proof), fold, fold == top[-1][0]))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
KEY = lambda r: tuple(map(str, r))


def got(spark, rows, schema=SCHEMA):
    out = merkle.verified(spark.createDataFrame(rows, schema))
    return [(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in out.collect()]


def made(n):
    langs = ["en"] * 5 + ["de", "é", None]
    return [(i * 3, f"s{i % 2}", langs[i % 8], i % 11 or None, "x" * (i % 13)) for i in range(n)]


def test_against_the_definition(spark, monkeypatch):
    monkeypatch.setattr(merkle, "HEIGHT", 2)
    monkeypatch.setattr(merkle, "RANGE_ROWS", 20)
    rows = made(150) + [(None, None, None, None, None)] * 3 + [(7, "a", "one", 1, "")] + [(9, "b", "en", 2, "same")] * 40 + [(9, "b", "en", 2, "other"), (12, "b", "de", 5, "word " * 50_000)]
    out = got(spark, rows)
    assert sorted(out, key=KEY) == sorted(brute(rows), key=KEY)
    assert any(r[6] for r in out) and any(not r[6] for r in out)


def test_each_small_size(spark, monkeypatch):
    monkeypatch.setattr(merkle, "HEIGHT", 2)
    rows = [(i, "s", f"lang{n}", 1, str(i)) for n in (1, 2, 3, 4, 5, 16, 17) for i in range(n)]
    assert sorted(got(spark, rows), key=KEY) == sorted(brute(rows), key=KEY)


def test_one_row(spark):
    assert got(spark, [(1, "a", None, 2, "t")]) == brute([(1, "a", None, 2, "t")])


def test_empty_and_further_columns(spark):
    assert got(spark, []) == []
    rows = made(20)
    wide = [(*r, "x", 1) for r in rows]
    assert sorted(got(spark, wide, SCHEMA + ", tree string, rank int"), key=KEY) == sorted(brute(rows), key=KEY)


def test_records_and_proofs_of_some_leaves(spark, monkeypatch):
    monkeypatch.setattr(merkle, "HEIGHT", 2)
    leaves = [sha(str(i)) for i in range(37)]
    nodes = spark.createDataFrame([(5, i, x) for i, x in enumerate(leaves)], "tree long, rank long, digest string")
    records, roots = merkle.trees(nodes)
    for r in records:
        for x in r.collect():
            assert levels_of(x.children)[-1][0] == x.digest or merkle.climbed(x.children, x.levels)[-1] == [x.digest]
    root = roots.first()
    assert (root.tree, root.digest, root.rounds) == (5, levels_of(leaves)[-1][0], 3)
    sizes = spark.createDataFrame([(5, 37)], "tree long, size long")
    asked = spark.createDataFrame([(5, 0), (5, 36), (5, 21)], "tree long, rank long")
    found = {r.rank: r for r in merkle.proofs(records, sizes, roots, asked).collect()}
    assert set(found) == {0, 21, 36} and found[21].digest == leaves[21]
    levels = levels_of(leaves)
    for at, r in found.items():
        want = "".join(level[at >> k ^ 1] for k, level in enumerate(levels[:-1]) if at >> k ^ 1 < len(level))
        assert "".join(reversed(r.path)) == want


def test_sql(spark, tmp_path):
    rows = made(60) + [(None, None, None, None, None), (9, "b", "en", 2, "same"), (9, "b", "en", 2, "same")]
    df = spark.createDataFrame(rows, SCHEMA).toPandas()
    con = duckdb.connect()
    con.register("d", df)
    con.execute("CREATE VIEW documents AS SELECT doc_id::BIGINT AS doc_id, source, lang, n_chars::BIGINT AS n_chars, text FROM d")
    out = con.execute(queries.ORACLES["op13_merkle_manifest"]).fetchall()
    assert sorted(out, key=KEY) == sorted(brute(rows), key=KEY)
