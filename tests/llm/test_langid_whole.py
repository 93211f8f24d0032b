"""The language model keeps every gram of every language."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tabwright.llm import langid


def test_model_keeps_all_grams(spark):
    rng = random.Random(4)
    noise = lambda n: "".join(chr(rng.randint(0x400, 0x4FF)) for _ in range(n))
    rows = [(k, noise(1500), "big") for k in range(30)] + [(100 + k, noise(500), "small") for k in range(4)]
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(known)
    total = {lang: [0.0, 0] for lang in model.langs}
    for lang in model.langs:
        column = known.where(f"lang = '{lang}'").select("text").toArrow().column(0).combine_chunks()
        for _, grams, sizes, _ in langid.grams_of(column):
            assert np.isin(grams, model.grams[-1]).all()
            loss = model.losses(grams, sizes)[:, model.langs.index(lang)]
            total[lang][0] += (loss * sizes).sum()
            total[lang][1] += sizes.sum()
    for k, lang in enumerate(model.langs):
        assert model.mean[k] == pytest.approx(total[lang][0] / total[lang][1], rel=1e-4)
