"""Keys that the classes or the allow-list once let through."""

import base64
import hashlib

from voxelith.llm import secrets


def spans(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secrets.scan(df).collect()}


def test_hexadecimal_keys_of_either_case(spark):
    key = hashlib.sha256(b"key").hexdigest()[:28]
    got = spans(spark, [f"key {key} end", f"key {key.upper()} end", f"key {key[:14]}{key[14:].upper()} end"])
    assert all(("entropy", 4, 32) in s for s in got.values())


def test_chance_marks_do_not_hide_keys(spark):
    blob = base64.b64encode(b"".join(hashlib.sha256(bytes([i])).digest() for i in range(60))).decode()
    key = blob[:18] + "//" + blob[20:40]
    long = blob[:1000] + "//" + blob[1002:1500] + "xxxx" + blob[1504:]
    got = spans(spark, [f"a {key} b", f"a {long} b"])
    assert all(any(kind == "entropy" for kind, *_ in s) for s in got.values())


def test_marks_still_excuse_examples(spark):
    blob = base64.b64encode(hashlib.sha256(b"x").digest()).decode()[:30]
    got = spans(spark, [f"a {blob}EXAMPLE b", f"http://{blob} b", f"a {blob}xxxx b"])
    assert all(not any(kind == "entropy" for kind, *_ in s) for s in got.values())
