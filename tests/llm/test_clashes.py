"""Extra columns whose names the operators use themselves pass through or are replaced, and never end a job."""

import pytest

import corpus_pipeline
from streamloom.llm import chat_format, decontaminate, lang_id, line_dedup, lm_score, mixing, multiset_hash, simhash_dedup, url_filter, warc

#: Every name that an operator gives a column of its own.
OWN = (
    "_d _t _th _th1 _fp _k1 _k2 _h _o _c _k _n _uid _known _logs _fixed _rare _more _also _word _bit _bits _guess _row _label _source _sha "
    "row at n h h1 h2 th hs gone id hash norm pos line size kind bucket hub component fp least conv k block before state told url_ host path rule guess "
    "sid p f name whole source_size level last blocks run halo head first item_id start win w c1 c2 value"
).split()
TEXT = "one two three four five six seven eight nine ten\nanother line of words stands here alone"


def rows(spark, base, schema):
    names = [n for n in OWN if n not in schema]
    fields = ", ".join([*(f"`{k}` {v}" for k, v in schema.items()), *(f"`{n}` string" for n in names)])
    return spark.createDataFrame([(*r, *[f"mine{i}" for _ in names]) for i, r in enumerate(base)], fields), names


def kept(df, names, replaced=()):
    found = df.collect()
    assert found
    for r in found:
        for n in names:
            if n not in replaced:
                assert str(r[n]).startswith("mine"), n


DOCS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def docs(spark):
    base = [(i, f"{TEXT}\n{'abcdefghij'[i]} own words of the document number {i} follow in this line", "en", f"s{i % 2}", 10) for i in range(8)]
    return rows(spark, [*base, (None, None, None, None, None)], DOCS)


def test_documents(spark):
    df, names = docs(spark)
    bench = spark.createDataFrame([(1, "no such item stands in any of these documents at all")], "item_id long, text string")
    kept(decontaminate.decontaminate(df, bench), names)
    kept(line_dedup.dedup_lines(df), names)
    kept(simhash_dedup.near_dedup(df), names)
    kept(simhash_dedup.components(df), names, {"fp", "_fp", "component"})
    kept(mixing.mix(mixing.sized(df).join(df.drop("size", "source"), "doc_id")), [n for n in names if n not in ("size", "source_size")])
    kept(mixing.mixed_documents(df), names)
    model = lang_id.train(df)
    kept(lang_id.predict(df, model), names)
    kept(lang_id.keep_identified(df, model, 0.0), names)
    kept(lm_score.score(df, df.select("text"), steps=2), names)
    assert multiset_hash.neighbours(df).count() == 9
    assert decontaminate.leaks(df, rows(spark, [(1, TEXT)], {"item_id": "long", "text": "string"})[0]).count() == 8


def test_other_tables(spark):
    turns, names = rows(spark, [(1, 0, "user", "hello?"), (1, 1, "assistant", "yes"), (None, None, None, None)], {"conv_id": "long", "turn": "long", "role": "string", "text": "string"})
    kept(chat_format.recover_roles(turns, chat_format.train(turns)), names)
    pages, names = rows(spark, [(1, "http://a.com/x", "<p>"), (2, None, None)], {"page_id": "long", "url": "string", "html": "string"})
    kept(url_filter.judge(pages), names, {"host", "path", "rule"})
    path = f"{spark.conf.get('spark.checkpoint.dir')}/clash-warc"
    warc.write(pages, path)
    assert warc.read(spark, path).count() == 2


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, sf, name, stage):
    df, names = docs(spark)
    out = stage(spark, df, sf)
    if name != "source_mixing":
        assert out.columns == df.columns
    kept(out, names)
    assert stage(spark, df.limit(0), sf).count() == 0
