from hashlib import sha256

from pyspark.sql import functions as F

from hydroframe.llm import chat
from tests.llm.helpers import ODD_TEXTS

SCHEMA = "conv_id long, turn long, role string, text string, turns string"


def test_escapes_are_reversible(spark):
    texts = [t for t in ODD_TEXTS if t is not None] + ["[INST]", "[/INST]</s>", "<s>", "\\|", "[\\|", "\\", "\\\\|", "<\\|["]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e")).withColumn("u", chat.unescape(F.col("e"))).collect()
    assert all(r.t == r.u and not any(c in r.e for c in (chat.START, chat.SEP, chat.END)) for r in rows)


def test_every_conversation_is_read_back(spark):
    rows = [(1, 0, "user", "</s>[INST] ok [/INST]", "x"), (1, 1, "assistant", "[INST] \\| <s>", "x"), (1, 2, "user", None, "x"), (1, 3, "assistant", "second é", "x")]
    rows += [(2, 0, "user", "alone", "x"), (3, 5, "assistant", "b", "x"), (3, 5, "assistant", "a", "x"), (3, 5, "assistant", "a", "x"), (4, None, None, None, "x"), (5, 0, "assistant", "y" * 200_000, "x"), (None, 0, "assistant", "no name", "x")]
    rows += [(6, k, ("user", "assistant")[k % 2], t, "x") for k, t in enumerate(ODD_TEXTS)]
    made = chat.examples(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    assert len(got) == len({r[0] for r in rows})
    for conv, r in got.items():
        own = sorted(((turn is not None, turn or 0, role or "", text or "") for c, turn, role, text, _ in rows if c == conv))
        said = [t for *_, role, t in own if role == "assistant"]
        assert (r.n_turns, r.loss_chars) == (len(own), sum(map(len, said)))
        assert r.turns_sha256 == sha256("".join(f"{role}\n{t}\n" for *_, role, t in own).encode()).hexdigest() and r.loss_sha256 == sha256("".join(said).encode()).hexdigest()
    assert chat.examples(spark.createDataFrame([], SCHEMA)).count() == 0
