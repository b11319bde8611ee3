"""Aligned tokens against the two libraries and groups made token by token."""

import collections
import hashlib
import random

import pytest

from melospark.llm import token_alignment as ta
from melospark.llm.bpe import _byte_alphabet


def plain_documents(rows):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    alphabet = _byte_alphabet()
    for doc_id, text in rows:
        ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        data = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids[0]]
        pieces = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
        whole = (" " + (text or "")).encode()
        groups, at = [], [0, 0]
        if text and b"".join(data) == whole == b"".join(pieces):
            ends = []
            for side in (data, pieces):
                place, out = 0, []
                for t in side:
                    place += len(t)
                    out.append(place)
                ends.append(out)
            for cut in sorted(set(ends[0]) & set(ends[1])):
                group = []
                for side in (0, 1):
                    stop = ends[side].index(cut) + 1
                    group.append(ids[side][at[side] : stop])
                    at[side] = stop
                groups.append((cut, *group))
        yield doc_id, groups


def plain_rows(rows):
    docs = list(plain_documents(rows))
    links = [collections.Counter((x, y) for _, a, b in groups for x in a for y in b) for _, groups in docs]
    count = collections.Counter(k for c in links for k in c)
    highest = {}
    for (x, _), n in count.items():
        highest[x] = max(highest.get(x, 0), n)
    for (doc_id, groups), link in zip(docs, links, strict=True):
        said = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for _, a, b in groups)
        yield (
            doc_id,
            sum(len(a) for _, a, _ in groups),
            sum(len(b) for _, _, b in groups),
            len(groups),
            sum(link.values()),
            sum(n for k, n in link.items() if count[k] == highest[k[0]]),
            sum(n * count[k] for k, n in link.items()),
            hashlib.sha256(said.encode()).hexdigest() if groups else "",
        )


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    letters = "ab c  \n\t\x00'é漢字☃ﬁ\xa0　👍0123456789====----<|endoftext|><0x41>́▁"
    out = [(10**6 + k, "".join(rng.choice(letters if k % 5 else letters[:-1]) for _ in range(rng.randrange(0, 120)))) for k in range(300)]
    out += [(1, None), (2, ""), (3, " "), (4, "\n"), (None, "hello there"), (None, "hello there"), (5, "=" * 3000), (6, "-" * 501 + "=a" * 700), (7, "<|endoftext|> x <s></s>")]
    return out + [(8, "a" * 5000), (8, "a" * 5000), (9, "the words of a longer text, it's said, " * 3000), (10, "a ▁ b")]


@pytest.mark.parametrize("block_bytes, part_bytes", [(3000, 200), (ta.BLOCK_BYTES, ta.PART_BYTES)])
def test_equals_the_libraries(spark, rows, block_bytes, part_bytes):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as block", "2 as pairs", "3 as n_a").repartition(3)
    got = [tuple(r) for r in ta.align_documents(docs, block_bytes=block_bytes, part_bytes=part_bytes).collect()]
    assert sorted(got, key=repr) == sorted(plain_rows(rows), key=repr)
    assert ta.align_documents(docs.limit(0)).collect() == []


def test_groups_as_rows(spark, rows):
    docs = spark.createDataFrame([r for r in rows if r[0] != 8], "doc_id long, text string").repartition(2)
    got = sorted((tuple(r) for r in ta.token_groups(docs, part_bytes=200).collect()), key=repr)
    want = []
    for doc_id, groups in plain_documents([r for r in rows if r[0] != 8]):
        before = 0
        for k, (cut, a, b) in enumerate(groups):
            want.append((doc_id, k, before, cut, a, b))
            before = cut
    assert got == sorted(want, key=repr)


def test_wide_groups_are_counted_by_ids(monkeypatch):
    two = ta.encoders(ta.default_vocabulary(), ta.default_pieces())
    data = (" " + "=" * 2000 + "-=" * 50 + "word").encode()
    x = ta.align([two.encode(data, False)], two)
    plain = [c.tolist() for c in ta.links(x, two)]
    monkeypatch.setattr(ta, "WIDE_GROUP", 1)
    assert [c.tolist() for c in ta.links(x, two)] == plain
