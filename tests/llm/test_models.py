"""Learnt operators: held-out accuracy, and what they may not look at."""

import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from netlens.llm import ftrl, langid, registry, toolcalls, toxicity

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = registry.op4_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id")
    right = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert right[0] > 0.97 and 0 <= right[1] and right[2] <= 1
    wrong = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, "zz").otherwise(F.col("lang")))
    assert langid.train(wrong).languages == langid.train(docs).languages


def test_language_of_odd_texts(spark):
    rows = [(1, "the cat sat on the mat and the dog", "en"), (2, "le chat est sur la table et le chien", "fr"), (4, None, "en"), (5, "123 !!", None), (6, "", "fr"), (7, "the dog", None), (None, "le chien", None), (1, "the cat sat on the mat and the dog", "en"), (8, "the " * 50_000, None)]
    rows += [(i, "le chat est sur la table et le chien" if i % 2 else "the cat sat on the mat and the dog", "fr" if i % 2 else "en") for i in range(20, 32)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.identify(df, langid.train(df)).collect()]
    by = {i: (p, s) for i, p, s in got}
    assert by[4] == by[5] == by[6] == ("und", 0.0) and by[7][0] == "en" and by[None][0] == "fr" and by[8][0] == "en" and len(got) == len(rows)
    none = langid.train(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.identify(df, none).collect()} == {"und"}
    assert langid.identify(df.where("false"), none).count() == 0


def test_prediction_is_a_dense_softmax_over_grams(spark):
    """One gram at a time, and all languages' sums written out."""
    rows = [(i, "le chat est sur la table et le chien" if i % 2 else "the cat sat on the mat and the dog", "fr" if i % 2 else "en") for i in range(20, 60)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = ["the dog", "le chien É", "x", "The CAT, 12 le!", "\u00df \u0130"]

    def naive(text):
        code = [ord(c) if c.isalpha() else 32 for c in f" {text.lower()}  "]
        sums, n = [0.0] * len(model.languages), 0
        for at in range(len(code) - 2):
            h = 0
            for k in range(langid.ORDERS):
                h = (h * 0x01000193 & 0xFFFFFFFF) ^ (code[at + k] * 0x85EBCA6B & 0xFFFFFFFF) ^ k
                bucket = ((h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF) >> 8
                sums = [s + float(w) for s, w in zip(sums, model.weights[bucket % langid.BUCKETS], strict=True)]
                n += 1
        e = [math.exp((s / n + b) / model.heat) for s, b in zip(sums, model.bias, strict=True)]
        return model.languages[e.index(max(e))], max(e) / sum(e)

    got = zip(*model.predict(texts), strict=True)
    for (name, score), text in zip(got, texts, strict=True):
        assert name == naive(text)[0] and abs(score - naive(text)[1]) < 1e-4, text


def test_the_language_sample_is_bounded_whatever_repeats(spark):
    rows = [(1, "le chat", "fr")] * 500 + [(i, f"the cat number {chr(97 + i % 26)}{chr(97 + i // 26)}", "en") for i in range(2, 400)] + [(3, "the mat", "en")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(table, per_language=20)
    assert model.languages == ["en", "fr"] and model.predict(["le chat"])[0] == ["fr"]


def test_ftrl_learns_and_stays_sparse():
    r = np.random.default_rng(0)
    model = ftrl.Ftrl(50, 2, l1=0.5)
    for _ in range(800):
        y = int(r.integers(2))
        at = np.unique(np.append(r.integers(2, 50, 5), y))
        model.learn(at, np.ones(len(at)), y)
    w = model.weights()
    assert w[0, 0] > w[0, 1] and w[1, 1] > w[1, 0] and (w[2:] == 0).mean() > 0.3
    assert ftrl.temperature(np.array([[4.0, 0], [0, 4.0], [4.0, 0]]), np.array([0, 1, 1])) > 1


def test_toxicity_of_held_out_documents(spark):
    found = registry.op2_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out")
    r = found.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double")), F.min("score"), F.max("score")).first()
    assert r[0] > 0.95 and 0 <= r[1] and r[2] <= 1


def trained(spark, n=120):
    clean = ["the quiet river runs along green fields", "she reads a book about old trains", "bread and butter with warm tea"]
    rows = [(i, f"{clean[i % 3]} {i}" + (" you stupid idiot stupid" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(n)]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, None), (5, 7)], "doc_id long, toxic int")
    return docs, labels


def test_obfuscated_words_are_read(spark):
    docs, labels = trained(spark)
    model = toxicity.train(docs, labels)
    for w in ("stup1d", "s.t.u.p.i.d", "stuuuupid", "$tupid", "1d10t"):
        assert model.readings(w)[1] in ("stupid", "idiot"), w
    assert model.readings("s t u p i d", True)[1] == "stupid" and model.readings("quiet") == ("quiet",)
    assert model.score("you st*pid 1d1ot stup1d you s t u p i d") > 0.7 > model.score("the quiet river runs") and 0 <= model.score("") < 0.5
    odd = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (None, "you stupid idiot stupid", 1.0), (4, "tea " * 50_000, 1.0), (4, "tea " * 50_000, 1.0), (6, "x" * 20_000 + "1", 1.0)], docs.schema)
    got = toxicity.scores(odd, model).collect()
    assert len(got) == 6 and [r.predicted for r in got if r.doc_id is None] == [1]
    kept = toxicity.keep_clean(odd, labels).collect()
    assert len(kept) == 6 and toxicity.keep_clean(docs.unionByName(odd), labels).columns == docs.columns


def test_reading_is_the_best_path_of_the_lattice(spark):
    docs, labels = trained(spark)
    reader = toxicity.train(docs, labels).reader
    r = random.Random(1)

    def brute(word, spaced):
        options, best = reader._options(word, spaced), (-1e9, "")
        for path in itertools.product(*options):
            score, context = 0.0, "   "
            for read, cost in path:
                score, context = reader.step(score, context, read, cost)
            score = reader.step(score, context, " " if context[-1] != " " else "", 0.0)[0]
            best = max(best, (score, "".join(read for read, _ in path)))
        return best

    def score_of(word, spaced, text):
        found = [-1e9]
        for path in itertools.product(*reader._options(word, spaced)):
            if "".join(read for read, _ in path) == text:
                score, context = 0.0, "   "
                for read, cost in path:
                    score, context = reader.step(score, context, read, cost)
                found.append(reader.step(score, context, " " if context[-1] != " " else "", 0.0)[0])
        return max(found)

    words = ["$#!7", "455", "s.t.u.p", "1d10t", "stuuupid", "@$$ 1 d", "*#*", "а1е"] + ["".join(r.choices("stupid1$@.*0#aoе", k=7)) for _ in range(60)]
    for w in words:
        spaced = " " in w
        assert abs(score_of(w, spaced, reader.read(w, spaced)) - brute(w, spaced)[0]) < 1e-9, w


def test_words_without_letters_and_rows_of_fragments_are_restored(spark):
    docs, labels = trained(spark)
    model = toxicity.train(docs, labels)
    assert model.readings("$7#@1")[1:] and model.joined("st\tu  pi d") == ["stupid"]
    assert model.readings("57*p1d")[1] == "stupid"
    for text in ("you 57*p1d 57*p1d 1d10t", "st u  pi d you\ti d i o t, st\nup id", "you " + "." * 200 + "s" + "." * 60 + "t.u.p.i.d 1d10t idiot"):
        assert model.score(text) > 0.7, text
    long = "stupid-" * 9000 + "1d10t"
    assert model.reader.read(long).endswith("idiot") and model.score("2023 455 10.5 100 20 3 4 5") < 0.5


def test_the_sample_is_bounded_and_repeated_ids_count_once(spark):
    docs, labels = trained(spark)
    many = docs.unionByName(docs.where("doc_id < 40").withColumn("text", F.concat("text", F.lit(" again"))))
    got = toxicity.sample(many, labels, "doc_id", "text", {1: 10, 0: 20}).groupBy("toxic").count().collect()
    assert {r.toxic: r["count"] for r in got} == {1: 10, 0: 20}


def test_toxicity_without_labels(spark):
    docs, labels = trained(spark, 8)
    assert toxicity.train(docs, labels.where("toxic = 0")) is None
    assert toxicity.scores(docs.where("false"), toxicity.train(*trained(spark))).count() == 0
    assert {(r.score, r.predicted) for r in toxicity.scores(docs, None).collect()} == {(0.0, 0)}
    assert toxicity.keep_clean(docs.where("false"), labels.where("false")).count() == 0


def talk(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, call_id string")


def calls(*cs):
    return json.dumps({"tool_calls": list(cs)})


SCHEMAS = {"add": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"enum": [1, 2]}}, "additionalProperties": False}}


def test_calls_are_linked_validated_and_written_canonically(spark):
    rows = [
        (1, 0, "assistant", calls({"id": "z", "name": "add", "arguments": {"b": 1, "a": 2.0}}, {"id": "y", "name": "add", "arguments": '{"a": -1, "c": 0}', "depends_on": ["z", "gone"]})),
        (1, 1, "tool", json.dumps({"tool_call_id": "z", "content": {"k": [1, 2.5], "é": None}})), (1, 2, "tool", json.dumps({"tool_call_id": "nobody", "content": "x"})), (1, 3, "tool", json.dumps({"tool_call_id": "z", "content": "late"})),
        (2, 0, "assistant", calls({"id": "z", "name": "other", "arguments": {}})), (None, 0, "assistant", calls({"id": "z", "name": "add", "arguments": {"a": 1}})), (3, None, None, None), (3, 1, "user", "plain"), (3, 2, "assistant", "{broken"),
    ]
    got = {(r.conv_id, r.call_id): r for r in toolcalls.link(talk(spark, [*rows, rows[0]]), SCHEMAS, plain=False).collect()}
    z = got[1, "z"]
    assert z.canonical == '{"arguments":{"a":2,"b":1},"id":"z","name":"add","result":{"k":[1,2.5],"é":null}}' and z.valid and z.result_turn == 1 and z.copies == 2
    assert got[1, "y"].errors == "dependency gone: missing; $.a: out of bounds; $.c: unknown" and got[1, "nobody"].kind == "orphan"
    assert got[2, "z"].errors == "tool other: unknown" and got[None, "z"].valid and len(got) == 5
    assert toolcalls.link(talk(spark, []), SCHEMAS).count() == 0


def test_calls_out_of_order_are_sorted_in_rounds(spark):
    call = lambda i, *deps: {"id": i, "name": "add", "arguments": {"a": 1, "b": {"$ref": deps[0]}} if deps else {"a": 1}, "depends_on": list(deps[1:])}
    rows = [(1, 0, "assistant", calls(call("c", "b"))), (1, 1, "assistant", calls(call("b", "a"))), (1, 2, "assistant", calls(call("a"))), (2, 0, "assistant", calls(call("p", "q"), call("q", "p"), call("r"))), (3, 0, "assistant", calls(call("m"), call("n", "m")))]
    got = {r.call_id: r.round for r in toolcalls.link(talk(spark, rows), SCHEMAS, plain=False).collect()}
    assert got == {"a": 1, "b": 2, "c": 3, "p": None, "q": None, "r": 1, "m": 0, "n": 0}


def test_long_chains_run_through_blocks(spark):
    r = random.Random(6)
    call = lambda i, deps: {"id": i, "name": "add", "arguments": {"a": 1}, "depends_on": deps}
    ids = [f"k{i}" for i in range(60)]
    deps = {i: [ids[k] for k in r.sample(range(n + 1, 60), min(2, 59 - n))] for n, i in enumerate(ids)}
    deps["k50"].append("loop")
    rows = [(7, n // 3, "assistant", calls(call(i, deps[i]))) for n, i in enumerate(ids)] + [(7, 99, "assistant", calls(call("loop", ["loop"])))]
    got = {x.call_id: x.round for x in toolcalls.link(talk(spark, rows), SCHEMAS, plain=False, block=7).collect()}

    def depth(i, seen=()):
        if i == "loop":
            return None
        below = [depth(d) for d in deps[i]]
        return None if None in below else 1 + max(below, default=0)

    assert got == {i: depth(i) for i in [*ids, "loop"]} and max(x for x in got.values() if x) > 5


def test_odd_messages_are_rows_and_not_errors(spark):
    big = str(10**400)
    deep = "[" * 3000 + "]" * 3000
    rows = [
        (1, 0, "assistant", calls({"id": None, "name": "add", "arguments": {"a": 1}}, {"name": "add", "arguments": {"a": 2}, "depends_on": 5}, {"id": 7, "name": "add", "arguments": {"a": 3}})),
        (1, 1, "tool", '{"tool_call_id": 7, "content": NaN}'), (1, 2, "tool", '{"tool_call_id": null, "content": 1}'),
        (1, 3, "assistant", '{"tool_calls": [{"id": "s\\ud800", "name": "add", "arguments": {"a": ' + big + ', "\\udfff": 1e-7}}]}'),
        (1, 4, "assistant", '{"tool_calls": [{"id": "d", "name": "add", "arguments": {"a": ' + deep + "}}]}"), (1, 5, "assistant", "[" * 200_000),
        (1, 6, "assistant", calls({"id": "n", "name": "add", "arguments": {"a": 10**21, "b": 2}})), (1, 7, "assistant", '{"tool_calls": [{"id": "m", "name": "add", "arguments": {"a": 1e21, "b": 2.0}}, 3]}'),
        (1, 8, "assistant", '{"tool_calls": 3}'),
    ]
    got = {r.call_id: r for r in toolcalls.link(talk(spark, rows), SCHEMAS, plain=False).collect()}
    assert got["1:0:0"].valid and got["1:0:1"].valid and got["7"].errors == "result: no JSON" and got["1:2:result"].kind == "orphan"
    s = got["s\\ud800"]
    assert s.canonical == '{"arguments":{"a":' + big + ',"\\udfff":1e-7},"id":"s\\\\ud800","name":"add","result":null}', s.canonical
    assert got["d"].errors in ("$.a: not integer", "$: no JSON") and got["n"].canonical.split('"id"')[0] == got["m"].canonical.split('"id"')[0] and "1:7:1" in got


def test_a_conversation_named_null_is_not_the_null_one(spark):
    rows = [("null", 0, "assistant", calls({"id": "z", "name": "add", "arguments": {"a": 1}})), (None, 1, "tool", json.dumps({"tool_call_id": "z", "content": 2}))]
    table = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    assert {(r.conv_id, r.kind) for r in toolcalls.link(table, SCHEMAS, plain=False).collect()} == {("null", "call"), (None, "orphan")}


@pytest.mark.parametrize(("value", "text"), [(1.0, "1"), (-0.0, "0"), (1e21, "1e+21"), (10**21, "1e+21"), (1e-7, "1e-7"), (1e-5, "0.00001"), (123456789.125, "123456789.125"), (5e-324, "5e-324"), (10**21 + 1, str(10**21 + 1)), (1.5e300, "1.5e+300"), (True, "true")])
def test_numbers_have_one_spelling(value, text):
    assert toolcalls.canonical(value) == text and toolcalls.canonical([[value], {"b": None, "a": "x"}]) == f'[[{text}],{{"a":"x","b":null}}]'


def test_plain_turns_are_exchanges(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (1, 5, "user", ""), (1, 9, "narrator", "x")]
    got = {r.call_id: r for r in toolcalls.link(talk(spark, rows)).collect()}
    assert got["1:1"].canonical == '{"arguments":{"text":"hi","turn":1},"id":"1:1","name":"reply","result":"hello"}' and got["1:1"].valid
    assert not got["1:5"].valid and got["1:0"].name == "configure" and len(got) == 3
