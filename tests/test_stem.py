"""Stems by Porter's second algorithm: words worked out from its published rules."""

import pyarrow as pa
import pytest

from corpusmith.functions import stem


@pytest.mark.parametrize("word, want", [
    ("caresses", "caress"), ("ties", "tie"), ("cries", "cri"), ("gas", "gas"), ("this", "this"), ("kiwis", "kiwi"), ("gaps", "gap"), ("bus", "bus"), ("grass", "grass"),
    ("agreed", "agre"), ("feed", "feed"), ("luxuriated", "luxuri"), ("hopping", "hop"), ("hoping", "hope"), ("sing", "sing"), ("running", "run"), ("falling", "fall"), ("fizzed", "fizz"),
    ("cry", "cri"), ("by", "by"), ("say", "say"), ("toys", "toy"), ("yellow", "yellow"), ("yielding", "yield"),
    ("relational", "relat"), ("conditional", "condit"), ("valency", "valenc"), ("digitizer", "digit"), ("organization", "organ"), ("feudalism", "feudal"), ("decisiveness", "decis"), ("hopefulness", "hope"), ("sensibility", "sensibl"), ("analogy", "analog"), ("quickly", "quick"), ("happily", "happili"),
    ("triplicate", "triplic"), ("formative", "format"), ("electrical", "electr"), ("goodness", "good"), ("formalize", "formal"),
    ("revival", "reviv"), ("inference", "infer"), ("adjustable", "adjust"), ("replacement", "replac"), ("adoption", "adopt"), ("homologous", "homolog"), ("opinion", "opinion"),
    ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controlling", "control"), ("roll", "roll"),
    ("generous", "generous"), ("general", "general"), ("generically", "generic"), ("communication", "communic"), ("arsenal", "arsenal"),
    ("skies", "sky"), ("dying", "die"), ("news", "news"), ("inning", "inning"), ("proceed", "proceed"), ("exceeding", "exceed"),
    ("knightly", "knight"), ("consistency", "consist"), ("consolation", "consol"), ("databases", "databas"), ("a", "a"), ("", ""), ("naïve", "naïv"), ("2024", "2024"),
])
def test_words(word, want):
    assert stem.stem(word) == want


def test_columns():
    assert stem.stems(pa.array(["running", None, "running", "cats"])).to_pylist() == ["run", None, "run", "cat"]
    assert len(stem.STOP) == len(set(stem.STOP)) == 127
