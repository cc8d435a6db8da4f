"""Token alignment against a plain walk over decoded bytes."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest
import sentencepiece
from fixtures_llm import documents, empty
from tokenizers import Tokenizer, decoders

from gustframe.llm import token_alignment as T

TEXTS = ["plain words, and plain words", "héllo wörld 你好 \U0001F600\U0001F601 é", "<|endoftext|> <s> </s> <0x0A> <unk>", "a▁b", " lead", "  two\t\n\r\n x",
         "\x00nul ﻿ bom", "é", " ", "\n", "\U0001F9FF", "ﬁ ½ Ⅷ  nbsp", "१२३ مرحبا שלום", "日本語のテキスト" * 50, "x" * 3000, "\U00020000\U00020001 rare", None, ""]


def brute(rows):
    tok = Tokenizer.from_file(T.BYTE_BPE)
    tok.encode_special_tokens = True
    alphabet, names = T.byte_alphabet(), {i: t for t, i in tok.get_vocab().items()}
    assert len(alphabet) == 256 and decoders.ByteLevel().decode([c for c, b in alphabet.items() if b < 128]) == "".join(chr(b) for b in alphabet.values() if b < 128)
    sp = sentencepiece.SentencePieceProcessor(model_file=T.PIECES)
    per, counts = [], Counter()
    for doc_id, text in rows:
        a = tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        bytes_a = [bytes(alphabet[c] for c in names[i]) for i in a]
        bytes_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            per.append((doc_id, 0, 0, 0, [], ""))
            continue
        ends_a, ends_b, at = {}, {}, 0
        for i, x in zip(a, bytes_a, strict=True):
            at += len(x)
            ends_a[at] = i
        at = 0
        for i, x in zip(b, bytes_b, strict=True):
            at += len(x)
            ends_b[at] = i
        cuts = sorted(set(ends_a) & set(ends_b))
        links = [(ends_a[c], ends_b[c]) for c in cuts]
        counts.update(links)
        parts, low = [], 0
        for c in cuts:
            parts.append(",".join(str(ends_a[e]) for e in sorted(ends_a) if low < e <= c) + "|" + ",".join(str(ends_b[e]) for e in sorted(ends_b) if low < e <= c))
            low = c
        per.append((doc_id, len(a), len(b), len(cuts), links, hashlib.sha256(";".join(parts).encode()).hexdigest()))
    top = defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return Counter((d, na, nb, g, len(ls), sum(counts[x] == top[x[1]] for x in ls), sum(counts[x] for x in ls), sha) for d, na, nb, g, ls, sha in per)


@pytest.mark.parametrize("hot", [T.HOT, 5])
def test_brute_force(spark, hot):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0]), (None, TEXTS[1]), (None, None)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, pairs string, row string")
    got = T.align(docs, hot=hot)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, got.collect())) == brute(rows)


def test_documents(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert Counter(map(tuple, T.align(docs).collect())) == brute(rows)
    assert T.align(empty(docs)).count() == 0


def test_parts_and_whole_texts_agree():
    own, whole = T.Aligner(), T.Aligner()
    assert own.cut
    whole.cut = False
    texts = [t for t in TEXTS if t] + ["  a  b \n c\n\n d .", "tail ", "two  ", " ", "  ", "a\u00a0 b", "x\x1c y", "it's 3 o'clock , \t e.g.  ,,, ..", "\u3000 wide \u2028 x"]
    plain = lambda found: [f and (*f[:3], f[3].tolist()) for f in found]
    assert plain(own.align_all(texts)) == plain(whole.align_all(texts)) == plain(own.align_all(texts))
    assert all("".join(own.parts(t)) == " " + t for t in texts)


def test_spans_and_bytes_agree(monkeypatch):
    """The coarse cuts alone give the ends wherever they say anything."""
    own, seen = T.Aligner(), []

    def ends(begin, end, sizes, at_byte):
        coarse, wide = end if at_byte is None else at_byte[end], end > begin
        sure = [k for k in range(len(end) - 1) if end[k] == begin[k + 1] and wide[k] and wide[k + 1]]
        assert [coarse[k] for k in sure] == [sizes.cumsum()[k] for k in sure]
        seen.append(len(sure) / len(end))
        return sizes.cumsum()

    monkeypatch.setattr(T, "token_ends", ends)
    own.align_all([t for t in TEXTS if t])
    assert len(seen) == 2 and min(seen) > 0.3
