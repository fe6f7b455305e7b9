"""Perspective rotation over hot conversations, many turns of one number, and clashing columns; archives of large pages."""

import random

import pytest

from tessera.llm import chat, warc


def brute(rows):
    """(conv, perspective, seq, segment, start, end, mask start, mask end)."""
    out = []
    for conv in {r[0] for r in rows}:
        mine = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        for speaker in {r for _, _, r, _ in mine if r != "system"}:
            at = 0
            for k, (_, _, role, text) in enumerate(mine):
                head = "<|im_start|>" + ("system" if role == "system" else "assistant" if role == speaker else f"user name={role}") + "\n"
                segment = head + text + "<|im_end|>\n"
                end = at + len(segment)
                out.append((conv, speaker, k + 1, segment, at, end, at + len(head) if role == speaker else None, end - 1 if role == speaker else None))
                at = end
    return out


@pytest.mark.parametrize("chunk", [2, 256])
def test_rotation(spark, chunk):
    rng = random.Random(8)
    rows = [(7, rng.choice([None, 1, 2, rng.randint(0, 400)]), rng.choice(["ann", "bob", "system", None]), rng.choice(["", "hé", "same", None, "x" * rng.randint(0, 30)])) for _ in range(600)]
    rows += [(rng.choice([None, 1, 2, 3]), rng.randint(0, 5), rng.choice("abc"), f"t{rng.randint(0, 9)}\n<|im_end|>") for _ in range(80)]
    rows += [(9, 1, "system", "alone")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, place long, seq long").repartition(5)
    got = [tuple(r) for r in chat.rotate(df, chunk).select("conv_id", "perspective", "seq", "segment", "start", "end", "mask_start", "mask_end").collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)
    assert chat.rotate(df.limit(0)).count() == 0


def test_text_ids(spark):
    df = spark.createDataFrame([(None, 1, "a", "x"), ("null", 1, "b", "y"), ("", 1, "c", "z")], "conv_id string, turn long, role string, text string")
    assert sorted((r.conv_id is None, r.conv_id or "", r.perspective, r.seq) for r in chat.rotate(df).collect()) == [(False, "", "c", 1), (False, "null", "b", 1), (True, "", "a", 1)]


def test_large_page(spark):
    rows = [(1, "u", "<p>" + "ab" * 4_000_000), (2, "u", "<p>" + "ab" * 4_000_000), (3, "u", "small"), (None, None, None)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "page_id long, url string, html string, content int")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(warc.write_archives(warc.with_revisits(df), b"<p>abab", archive_bytes=1000)).collect()}
    assert got == {1: (8_000_003, "response", None), 2: (8_000_003, "revisit", 1), 3: (5, "response", None), None: (0, "response", None)}
