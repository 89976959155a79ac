"""What the tests of this folder share."""

import math
import re

import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import language_id, secrets


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def plain_rows(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(map(plain, r)) for r in frame[names].astype(object).values.tolist())


def brute_pipeline(spark, sf_dir, docs):
    """The kept ids and their numbers of tokens, by plain loops after the trained models' own judgements."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    judged = language_id.predict(table, language_id.fit(table)).collect()
    left = {r["doc_id"] for r in judged if r["lang_pred"] != "und" and r["score"] >= 0.3}
    sets = {}
    for k in left:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), docs[k]["text"]))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    comp = {k: k for k in left}
    for a in sorted(left):
        for b in sorted(left):
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                low, high = sorted((comp[a], comp[b]))
                comp = {k: low if v == high else v for k, v in comp.items()}
    left = {k for k in left if comp[k] == k}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        item = words(r["text"])
        size = min(10, len(item))
        if size:
            left = {k for k in left if not grams(item, size) & grams(words(docs[k]["text"]), size)}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    kept = table.filter(table.doc_id.isin(sorted(left)))
    model = secrets.train(kept)
    count = lambda t: len(tokenizer.encode(secrets.redacted(t, secrets.all_spans(t, model, 1.0)), add_special_tokens=False).ids)
    return left, {k: count(docs[k]["text"]) for k in left}
