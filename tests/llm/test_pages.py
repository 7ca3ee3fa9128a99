import json
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from moenda.llm import lines, pages, records
from moenda.operators import skew

SCHEMA = "row_number bigint, id string, domain_id string, url string, title string, text string, html string, extra string"


def page(k, site, body, html=True, dup=None):
    title = f"Artigo número {'abcdefghij'[k % 10]} sobre {'xyz'[k % 3]} | Guia Foobar"
    head = title.split(" |")[0]
    text = f"Início / Contato / Fotos\n{head}\n{body}\nLeia também: outra coisa {k}\nCopiar link | Imprimir\n© 2020 Guia Foobar. Todos os direitos."
    parts = text.split("\n")
    h = f"<html><head><title>{title}</title></head><body><nav><ul><li><a>Início</a></li><li><a>Contato</a></li><li><a>Fotos</a></li></ul></nav><main><h1>{head}</h1><p>{body}</p><div class='lt'><p>{parts[3]}</p></div><div class='sh'><p>{parts[4]}</p></div></main><footer><p>{parts[5]}</p></footer></body></html>"
    return (k, str(dup if dup is not None else k), site, "http://a.example/x", title, text, h if html else None, "x")


@pytest.fixture(scope="module")
def stored(spark):
    rows = [page(k, "s", f"Corpo próprio da página {'klmnopqrst'[k]} com palavras bastantes para ser o texto principal, {'uvw'[k % 3] * 40}.") for k in range(8)]
    rows.append(page(8, "s", "Outro corpo sem html que continua bastante longo para parecer uma frase inteira.", html=False))
    rows.append((9, "9", None, None, None, "  \nsó isto\n", "", "x"))
    rows.append((10, "10", "s", None, None, None, None, None))
    return spark.createDataFrame(rows, SCHEMA)


def test_surroundings(stored):
    got = defaultdict(set)
    for r in pages.surroundings(stored).collect():
        assert r["line_no"] not in got[r["row_number"]]
        got[r["row_number"]].add(r["line_no"])
    assert all(got[k] == {0, 3, 4, 5} for k in range(8))
    assert got[8] >= {0, 4, 5} and not got[8] & {1, 2}
    assert got[9] == set() and got[10] == set()
    clean = {r["row_number"]: r for r in lines.without_lines(stored, pages.surroundings(stored)).collect()}
    assert clean[0]["text"].startswith("Artigo") and clean[0]["removed"] == 4 and clean[10]["text"] is None and clean[9]["text"] == "  \nsó isto\n"


def test_parts_of_an_article_stay(spark):
    def own(k, n):
        return " ".join(f"{'abcdefghij'[k]}{'klmnopqrst'[j % 10]}{'uvwxyz'[j // 10 % 6]}palavra" for j in range(n)).capitalize() + "."

    rows = []
    for k in range(6):
        head = f"Manchete {'abcdefghij'[k] * 5} do dia"
        once = f"<div class='caixa-{k}'><p>Nota sobre {'klmnopqrst'[k] * 6}</p></div>"  # its place is on this page only
        cells = f"<table><tr><th>Origem</th><td>Terra {'abcdefghij'[k] * 4}</td></tr></table>"
        figure = f"<figure><img><figcaption>Foto de {'uvwxyz'[k] * 7} na praça</figcaption></figure>"
        sections = "".join(f"<section class='s'><p>{own(k, 60 + j)} {'abcdefghij'[k] * (j + 2)}</p></section>" for j in range(2))
        teaser = f"<div class='rel'><p>Leia mais {'klmnopqrst'[k] * 3}</p><div class='post-{k}'><p>Outra {'klmnopqrst'[k] * 4}</p></div></div>"
        share = "<div class='sh'><p>Copiar link</p></div>"
        html = f"<html><body><nav>Início</nav><main><h1>{head}</h1><p>Abertura {own(k, 8)}</p>{figure}{cells}{once}{sections}{teaser}{share}</main></body></html>"
        text = "\n".join(x.strip() for x in re.split(r"<[^>]+>", html) if x.strip())
        rows.append((k, str(k), "s", None, f"{head} | Sítio", text, html, "x"))
    got = defaultdict(set)
    lines_of = {r[0]: r[5].split("\n") for r in rows}
    for r in pages.surroundings(spark.createDataFrame(rows, SCHEMA)).collect():
        got[r["row_number"]].add(lines_of[r["row_number"]][r["line_no"]].split()[0])
    assert all(got[k] == {"Início", "Leia", "Outra", "Copiar"} for k in range(6)), got


def test_no_rows(stored):
    assert pages.surroundings(stored.filter("false")).count() == 0
    assert lines.repeated_lines(stored.filter("false")).count() == 0


def test_tree():
    tree = pages.Tree("<body><div class=a>um <b>dois</b><p>três</div><div>x&amp;y<script>z()</script></div><!-- fim")
    assert tree.stream == "umdoistrêsxy" and len(tree.parent) == 3
    assert pages.aligned(["umdois", "três", "xy", "nada", ""], tree) == [1, 1, 2, -1, -1]
    pages.Tree("<" * 5000 + "<div" * 1000)


def brute_lines(rows, least):
    keys = defaultdict(set)
    each = []
    for r in rows:
        if r["domain_id"] is None or r["text"] is None:
            continue
        for n, line in enumerate(r["text"].split("\n")):
            key = re.sub(r"[\W\d_]+", "", line.lower())
            if key:
                keys[r["domain_id"], key].add(r["id"])
                each.append((r["row_number"], n, (r["domain_id"], key)))
    return sorted((a, b) for a, b, k in each if len(keys[k]) >= least)


def test_repeated_lines_equal_brute_force(spark, data):
    table = spark.read.parquet(f"{data}/wackywacky.parquet")
    got = sorted(map(tuple, lines.repeated_lines(table).collect()))
    assert got == brute_lines([r.asDict() for r in table.collect()], 5) and got
    shared = lines.repeated_lines(table, min_share=0.9).count()
    assert 0 <= shared <= len(got)


def test_one_id_counts_once(spark):
    rows = spark.createDataFrame([(k, "same" if k < 4 else str(k), "d", None, None, "A-b 1\nab\n12\n\nÁb", None, None) for k in range(8)], SCHEMA)
    assert sorted(map(tuple, lines.repeated_lines(rows).collect())) == [(k, n) for k in range(8) for n in (0, 1, 4)]
    assert lines.repeated_lines(rows, min_documents=6).count() == 0


def test_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_KEYS", 3)
    rows = spark.range(300).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).cast("bigint").alias("k"), F.col("id").alias("row"))
    counted = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("row").alias("top"))
    got = skew.join_counted(rows, counted, ["k"], ["top"], F.xxhash64("row"), 300).collect()
    assert len(got) == 300 and all(r["top"] == (297 if r["k"] == 7 else r["row"]) for r in got)


RECORDS = [
    "Olá, Mundo!", "olá mundo", "OLA MUNDO", "o l á m u n d o", "Olá mundo", "Peso: 3 kg\nOrigem: Aqui", '{"Origem": "aqui", "Peso":"3 KG"}', "origem = AQUI | peso = 3kg", "Origem: aqui; Peso: 3 kg.",
    "Peso: 3 kg\nOrigem: Ali", "Peso: 3 kg", "...", "", None, "x" * 100_000, "X" * 100_000, "ab", "ba",
]


def test_records(spark):
    rows = spark.createDataFrame([(k, t, "x") for k, t in enumerate(RECORDS)], "row_number bigint, text string, a string")
    keys = records.refined(rows)
    got = sorted(map(tuple, records.copies(keys).collect()))
    assert got == [(0, 1), (0, 3), (0, 4), (5, 6), (5, 7), (5, 8), (14, 15)]
    counts = {r["kept_row"]: r["copies"] for r in records.records(keys).collect()}
    assert counts == {0: 4, 2: 1, 5: 4, 9: 1, 10: 1, 14: 2, 16: 1, 17: 1}
    assert records.copies(records.refined(rows.filter("false"))).count() == 0


def test_records_equal_brute_force(spark, data):
    table = spark.read.parquet(f"{data}/wackywacky.parquet")
    groups = defaultdict(list)
    for r in sorted(table.select("row_number", "text").collect()):
        if r["text"]:
            fields = records.named_fields(r["text"])
            key = fields or records.folded(r["text"])
            if key:
                groups[key].append(r["row_number"])
    want = sorted((g[0], x) for g in groups.values() for x in g[1:])
    assert sorted(map(tuple, records.copies(records.refined(table)).collect())) == want and want


def test_records_of_any_size(spark):
    long = [(f"campo {k:04d}", f"valor {k} " + "y" * 20) for k in range(1000)]
    named = [("Data de entrega do pedido", "hoje"), ("x" * 70, "1")]
    prose = "Como assinar: as dicas\nNo fim da tarde. Ao rever o acordo, o relator disse: não"
    texts = [
        "\n".join(f"{a}: {b}" for a, b in long), "; ".join(f"{a} = {b}" for a, b in long[::-1]), json.dumps(dict(long)),
        "\n".join(f"{a}: {b}" for a, b in named), json.dumps(dict(named[::-1])), " | ".join(f"{a}={b}" for a, b in named[::-1]),
        prose, prose.replace(":", " -"),
    ]
    assert len(texts[0]) > 20_000
    rows = spark.createDataFrame(list(enumerate(texts)), "row_number bigint, text string")
    keys = records.refined(rows)
    assert sorted(map(tuple, records.copies(keys).collect())) == [(0, 1), (0, 2), (3, 4), (3, 5), (6, 7)]
    assert {r["kept_row"]: r["copies"] for r in records.records(keys).collect()} == {0: 3, 3: 3, 6: 2}
    # linear, whatever does not parse
    for odd in ("a:" + " " * 200_000 + "b\nc", '{"a": 1' + " " * 200_000 + '"}', '{"' + "x" * 200_000 + "}", "a" * 200_000 + ";" + "b:c"):
        assert records.named_fields(odd) is None


def test_records_chain_by_letters_and_pairs(spark):
    # the same pairs, then the same letters, then the same pairs again
    texts = ["B: c\nAx: d", "Ax: d\nB: c", "A: xd\nB: c", "B: c\nA: xd", "A: xd\nC: b"]
    keys = records.refined(spark.createDataFrame(list(enumerate(texts)), "row_number bigint, text string"))
    assert sorted(map(tuple, records.copies(keys).collect())) == [(0, 1), (0, 2), (0, 3)]


def test_invariant_is_blind_to_order():
    assert records.invariant("abc") == records.invariant("cab") != records.invariant("abd")
    assert records.invariant("\U0001d52bab") == records.invariant("ba\U0001d52b")
