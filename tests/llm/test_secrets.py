"""Values of passwords and tokens in any spelling and of any length."""

import pytest

from marginalia.llm import pseudonyms

LONG = "Ab3" * 100


@pytest.mark.parametrize("form", ["token=%s", "token: %s", "TOKEN = '%s'", "Password=%s", "password = %s", "password: %s", 'api_token = "%s"', '{"password": "%s"}', "password=%s"])
def test_named_secrets(spark, form):
    values = ["abc", "k3y9xQ17", "a1=b2c3", LONG]
    docs = spark.createDataFrame([(k, "see " + form % v + " here") for k, v in enumerate(values)], "doc_id long, text string")
    for r in pseudonyms.pseudonymise(docs, "key").collect():
        v = values[r.doc_id]
        head, tail = ("see " + form + " here").split("%s")
        assert r._n_replaced == 1 and r.text.startswith(head) and r.text.endswith(tail)
        new = r.text[len(head) : len(r.text) - len(tail)]
        assert len(new) == len(v) and new != v and new[100:] != v[100:] or len(v) <= 100 and new != v
