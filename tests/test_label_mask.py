"""label_mask against plain Python over whole texts."""

import re

from pairlight.plans import audit_queries


def plain(text, n=32):
    m = re.match(r"(?s).*?[.!?…。！？]+[\"'”’»)\]]*(?= |\Z)", text)
    p, f = ([len(w) for w in t.split(" ") if w] for t in (m.group() if m else text, text))
    r = f[len(p) :]
    if len(f) <= n:
        kept, tail = p, r
    else:
        tail = r[-n:]
        kept = p[max(0, len(p) - (n - len(tail))) :]
    return ",".join(map(str, kept + tail)), ",".join(map(str, [-100] * len(kept) + tail))


def test_label_mask_reads_whole_texts(spark, tmp_path):
    words = [f"{'x' * (1 + i % 9)}" for i in range(2000)]
    texts = {
        1: "A short prompt. " + " ".join(words),
        2: "A prompt “of one kind.” Then an answer.",
        3: " ".join(words),
        4: " ".join(words[:60]) + ". " + "And 3.5 end here? " * 3,
        5: "",
        6: "one  two\nthree",
    }
    spark.createDataFrame(list(texts.items()) + [(7, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["input_ids"], r["labels"]) for r in audit_queries.label_mask(spark, str(tmp_path)).collect()}
    assert got == {k: plain(t) for k, t in texts.items()}
    assert got[1][0] == ",".join(str(len(w)) for w in words[-32:])
