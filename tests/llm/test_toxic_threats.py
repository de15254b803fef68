"""Threats by the state they are met in, and a model without insults."""

import random

from cloudsift.llm import toxicity
from tests.llm.test_operators import prose, table


def test_threats_have_states():
    grammar = toxicity.Grammar(toxicity.Model({}))
    channel = lambda text: {c: v for c, v in zip(toxicity.CHANNELS, grammar.channels(text), strict=True) if v}
    assert channel("I will kill you.") == {"threat": 1, "threat_aimed": 1}
    assert channel("It might burn. I would never hurt you.") == {"threat": 1, "threat_negated": 1}
    assert channel("Police said the man would kill.") == {"threat_reported": 1}


def test_threats_without_insults(spark):
    rng = random.Random(4)
    clean = ["the frost will kill it. i see you", "i would never kill you", "police said that the man would kill you"]
    pool = [prose(rng, 20) for _ in range(5)]
    docs = [(i, f"{pool[i // 2 % 5]}. {'i will kill you' if i % 2 else clean[i // 2 % 3]}.") for i in range(240)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(240)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(table(spark, docs), labels)
    grammar = toxicity.Grammar(model)
    score = lambda text: grammar.score(grammar.channels(text))
    assert not model.insults
    assert score("I will kill you") >= 0.5 > max(score("I would never kill you"), score("He said they would kill you"), score("plain words"), score(""))


def test_negated_words_are_no_insults():
    assert "grunk$" in toxicity.terms_of("you grunk. he is not a blorf") and not {"blorf$", "blor"} & toxicity.terms_of("you grunk. he is not a blorf")
