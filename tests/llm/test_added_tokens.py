"""op1 against the library's own call on texts that hold an added token's literal."""

import numpy as np
import public_tokenizers

from wardflow.llm import planes
from wardflow.session import run_folder


def test_literals_of_added_tokens(spark):
    from tokenizers import Tokenizer

    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(vocabulary)
    literals = [t.content for t in plain.get_added_tokens_decoder().values()]
    assert literals
    texts = ["hello world", *[f.format(x) for x in literals for f in ("hello {0} world", "a{0}b c", "{0}", " {0} {0} end")], "hello <|endof text|> world", "end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = run_folder(spark, "planes-test")
    planes.write(docs, path, vocabulary)
    got = [(r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in sorted(planes.read(spark, path).collect(), key=lambda r: r.start)]
    want, start = [], 0
    for i, t in enumerate(texts):
        want.append((i, start, [*plain.encode(t, add_special_tokens=False).ids, 0]))
        start += len(want[-1][2])
    assert got == want
