"""Stages leave given columns alone, whatever their names."""

import re
from pathlib import Path

import pytest

from corpusloom.llm import minhash, mixing, secrets

STAGES = {minhash.one_per_class: "minhash", mixing.mixed: "mixing", secrets.mask_secrets: "secrets"}


@pytest.mark.parametrize("stage", STAGES)
def test_every_name_in_the_code(spark, stage):
    """Any quoted word of the module may be a column of the documents."""
    source = (Path(minhash.__file__).parent / f"{STAGES[stage]}.py").read_text()
    names = {m.lower() for m in re.findall(r"[\"']([A-Za-z_][A-Za-z_0-9]*)[\"']", source)}
    names |= {"_id", "_nth", "_a", "_b", "_live", "_copies", "_copy", "_source", "_shuffle", "c_id", "k_id", "l_id", "given", "live_"}
    names -= {"doc_id", "text", "lang", "source", "n_chars"}
    docs = spark.createDataFrame(
        [(i, f"a few words of text number {i} in source and no more than that", "en", "ab"[i % 2], 9) for i in range(6)]
        + [(7, None, "en", None, 0), (None, "key Zx9-QwErTy_1234567890-abcDEF", "en", "c", 32)],
        "doc_id long, text string, lang string, source string, n_chars long")
    wide = docs.selectExpr("*", *[f"concat('{n}', coalesce(string(doc_id), 'none')) as `{n}`" for n in sorted(names)])
    plain = sorted(map(str, stage(docs).collect()))
    got = stage(wide)
    assert got.columns == wide.columns
    assert sorted(map(str, got.select(docs.columns).collect())) == plain
    for row in got.select("doc_id", *sorted(names)).collect():
        assert all(row[n] == f"{n}{'none' if row.doc_id is None else row.doc_id}" for n in names)
