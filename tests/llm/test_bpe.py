import random

import public_tokenizers
from tokenizers import Tokenizer

from bidloom.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
CASES = [
    "", " ", "\t\n", "hello world", "It's they'LL don't 'S", "Ünïcödé ΣΑΣ ΌΣΟΣ İstanbul", "aaaaaaaaaaaaaaaaaaaaaaaa", "1234567 ½ ²",
    "<|startoftext|>hi <|endoftext|>there<|endoftext|>", "< |endoftext|>", "日本語のテキスト 🙂🙂 á é̂", "\x00\x01 a\x85b c d",
    "!!!???...:::", "x" * 3000, "ab" * 2000, "token = \"1eb9\" +1 (499) 555-6503", "​ zero​width", "ﬁ ﬃ ǅ ß ẞ", "क्षि नमस्ते",
]


def test_same_ids_as_the_library():
    ours, theirs = bpe.Encoder(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(7)
    letters = "abcdehiorstßéñ 'sdt.,!1<>|é"
    cases = CASES + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    for text in cases:
        want = theirs.encode(text, add_special_tokens=False).ids
        assert ours.encode(text) == want, text
        assert ours.decode(want) == theirs.decode(want, skip_special_tokens=False), text


def test_every_character_as_the_library():
    """Character tables of another Unicode version make no difference."""
    ours, theirs = bpe.Encoder(PATH), Tokenizer.from_file(PATH)
    new = [c for runs in (bpe.LETTERS_16, bpe.NUMBERS_16, " ".join(bpe.NEW_CAPITALS)) for a, b in bpe._ranges(runs) for c in (a - 1, a, (a + b) // 2, b, b + 1)]
    chars = list(map(chr, [*range(0x2100), *range(0xA700, 0xA800), *range(0x10D00, 0x10E00), *range(0x16E80, 0x16EE0), *range(0x323A0, 0x323C0), *new]))
    cases = [f"a{c}b{c}1{c}! {c}{c}" for c in chars]
    assert not [t for t, want in zip(cases, theirs.encode_batch(cases, add_special_tokens=False)) if ours.encode(t) != want.ids]


def test_added_tokens_and_their_flags(tmp_path):
    """Tokens of any spelling are found; blanks beside them and whole words as the flags say."""
    import json

    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    flags = [("[CLS]", 1, 0, 0, 0), ("<unk>", 0, 1, 0, 0), ("maskqx", 0, 0, 1, 0), ("sepqx", 0, 0, 1, 1)]
    spec["added_tokens"] += [{"id": 49408 + k, "content": c, "lstrip": bool(a), "rstrip": bool(b), "single_word": bool(w), "normalized": bool(n), "special": False} for k, (c, a, b, w, n) in enumerate(flags)]
    (tmp_path / "t.json").write_text(json.dumps(spec), encoding="utf-8")
    ours, theirs = bpe.Encoder(str(tmp_path / "t.json")), Tokenizer.from_file(str(tmp_path / "t.json"))
    for text in ("a [CLS] b<unk> c", "maskqx maskqxs unmaskqx maskqx.", "SEPQX sepqx sepqxarate", "<|endoftext|>[CLS]<unk>", "x  [CLS]  [CLS]"):
        assert ours.encode(text) == theirs.encode(text, add_special_tokens=False).ids, text


def test_query_rules(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hello  world", "x"), (3, "Hello  world", "x"), (4, "a" * 50_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, bpe.digests(docs).select("doc_id", "n_tokens").collect()))
    assert got[:4] == [(1, 0), (2, 0), (3, 2), (3, 2)]
    ids = {r.doc_id: (r.ids, r.decoded) for r in bpe.encoded(docs).collect()}
    assert ids[1] == ([], "")
    assert ids[3][1] == "hello</w> world</w>"
    assert bpe.digests(docs.limit(0)).collect() == []
