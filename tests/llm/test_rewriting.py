"""Token files, spelling variants and fill-in-the-middle."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from leaklens.llm import fill_in_middle, spelling, token_files

SCHEMA = "doc_id long, text string, n string, word string, output long, kind int, cell string, tie long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1, 2, "z", 3) for i, t in rows], SCHEMA)


# --- fill in the middle -------------------------------------------------

def by_hand(text, doc_id):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return len(lines), "plain", None, None, text
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    if h[3] % 100 < 50:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab\n\r é🙂<PSM> ", max_size=60), st.integers(0, 10**6), st.integers(1, 9))
def test_cuts_equal_split_lines(text, doc_id, block):
    assert fill_in_middle.rearranged(text, doc_id, block=block) == by_hand(text, doc_id)


@pytest.mark.parametrize("block", [1, 7, 64, 4096])
def test_tree_finds_every_line_end(block):
    rng = random.Random(3)
    text = "".join(rng.choice("aé🙂\n") for _ in range(700))
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    tree = fill_in_middle.LineTree(text.encode(), block)
    assert (tree.units, tree.points) == (len(lines), len(text))
    for k in range(len(lines) + 2):
        head = "".join(lines[:k])
        assert tree.after(k) == (len(head.encode()), len(head))


def test_examples_can_be_undone(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("ab<é\n >") for _ in range(rng.randrange(300)))) for i in range(200)]
    rows += [(900, None), (901, ""), (902, "x<P>y\n"), (903, "<"), (904, "\n\n\n"), (905, "ab\n" * 200_000), (None, "a\nb\nc"), (3, "again\n")]
    made = fill_in_middle.fill_in_middle(frame(spark, rows))
    assert made.columns == ["doc_id", "text", "word", "kind", "cell", "tie", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = made.withColumn("back", fill_in_middle.restored(made["output"], made["form"])).collect()
    assert Counter((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == \
        Counter((i, t, *by_hand(t, i)) for i, t in rows)
    assert all(r.back == (r.text or "") for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle.fill_in_middle(frame(spark, [])).count() == 0


# --- token files --------------------------------------------------------

@pytest.fixture(scope="module")
def tokenizer():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return file.read()


def encoded(tokenizer, texts, end=2):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(tokenizer)
    t.encode_special_tokens = True
    return [t.encode(x or "", add_special_tokens=False).ids + [end] for x in texts]


def test_pieces_encode_as_whole_texts(tokenizer, monkeypatch):
    monkeypatch.setattr(token_files, "CACHE", 50)       # generations turn over
    rng = random.Random(5)
    marks = [" ", " ", "  ", "\n", "\t", "a", "bc", "'s", "'", "1", "é", "<|endoftext|>", "#", "\x1c", "\x85", "漢", "🙂", ".", "!?", "\0"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(15))) for _ in range(4000)]
    encode = token_files.Encoder(tokenizer, 2, "<u2", True)
    got = [x for at in range(0, 4000, 100) for x in encode(texts[at:at + 100])]
    assert got == [np.array(x, "<u2").tobytes() for x in encoded(tokenizer, texts)]


def test_new_pieces_are_encoded_together_and_once(tokenizer):
    words = [f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100]}" for i in range(1000)]
    texts = ["Start " + " ".join(w + mark for w in words) for mark in ("", ",", ".", "!!", "'s", "é", "\u0149.", "_", "\n")]
    encode = token_files.Encoder(tokenizer, 2, "<u2", True)
    seen, plain = [], encode._encode
    encode._encode = lambda pieces: seen.extend(pieces) or plain(pieces)
    want = [np.array(x, "<u2").tobytes() for x in encoded(tokenizer, texts)]
    assert encode(texts[:4]) == want[:4]
    assert len(seen) < 20 and sum(map(len, seen)) < 2 * len(texts[0])       # not 4000 texts, and the words once
    encode.spaced = np.zeros_like(encode.spaced)        # a vocabulary that does not show the spaces
    assert encode(texts) == want and encode(texts[4:]) == want[4:] and encode([]) == []


def expected(tokenizer, rows):
    """Entries in ascending doc_id order; rows of one id in any order."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    ids = encoded(tokenizer, [t for _, t in rows])
    start = np.cumsum([0, *map(len, ids)])
    return [(i, int(a), len(x), zlib.crc32(np.array(x, "<u4").tobytes()), x) for (i, _), a, x in zip(rows, start, ids)]


@pytest.mark.parametrize("end_id", [2, 50256])
def test_files_hold_every_document(spark, tokenizer, tmp_path, end_id, monkeypatch):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["one", "two,", "né#", "x\n"]) for _ in range(rng.randrange(80)))) for i in range(-20, 300)]
    rows += [(None, "no id"), (1000, None), (1001, ""), (2**40, "far"), (1002, "long text # " * 60_000)]
    rng.shuffle(rows)
    folder = str(tmp_path / f"ids-{end_id}")
    token_files.write(frame(spark, rows).repartition(5), folder, tokenizer, end_id)
    kind = token_files.id_type(tokenizer, end_id)
    assert kind == ("<u2" if end_id == 2 else "<u4")
    want = expected(tokenizer, rows)
    if end_id != 2:
        want = [(i, a, n, zlib.crc32(np.array([*x[:-1], end_id], "<u4").tobytes()), [*x[:-1], end_id]) for i, a, n, _, x in want]
    for mapped in (True, False):
        got = token_files.read(spark, folder, kind, whole=True, mapped=mapped).collect()
        assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) for r in got), key=lambda r: r[1]) == want
    flat = np.concatenate([np.fromfile(x, kind) for x in sorted(tmp_path.glob(f"ids-{end_id}/kind=0/part-*"))])
    assert flat.tolist() == [x for *_, ids in want for x in ids]


def test_repeated_ids_and_no_rows(spark, tokenizer, tmp_path):
    rows = [(7, "same words"), (7, "same words"), (7, "other"), (8, "last")]
    token_files.write(frame(spark, rows), str(tmp_path / "a"), tokenizer)
    got = sorted(token_files.read(spark, str(tmp_path / "a"), "<u2").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [7, 7, 7, 8]
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == Counter((i, c) for i, _, _, c, _ in expected(tokenizer, rows))
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
    token_files.write(frame(spark, []), str(tmp_path / "b"), tokenizer)
    for mapped in (True, False):
        assert token_files.read(spark, str(tmp_path / "b"), "<u2", mapped=mapped).count() == 0


# --- spelling variants --------------------------------------------------

def counted(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(*spelling._LOWER))
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def grouped(n):
    near = defaultdict(list)
    for a in n:
        near[a] = [b for b in n if apart(a, b)]
    form = {}
    for a, found in near.items():
        best = min(found, key=lambda b: (-n[b], b), default=None)
        form[a] = best if best and n[best] >= 5 * n[a] else None
    out = {}
    for a in n:
        root = a
        while form[root]:
            root = form[root]
        out[a] = (form[a], root, n[a], len(near[a]), n[form[a]] if form[a] else None)
    return out


@pytest.fixture(scope="module")
def spelled():
    rng = random.Random(8)
    base = ["".join(rng.choice("abeérsÀ") for _ in range(rng.randrange(6, 9))) for _ in range(40)]
    vocabulary = list(base)
    for w in base:
        for _ in range(6):
            i = rng.randrange(len(w) + 1)
            vocabulary.append(rng.choice([w[:i] + rng.choice("abÿ") + w[i:], w[:i] + w[i + 1:], w[:i] + "c" + w[i + 1:]]))
    rows = []
    for i in range(300):
        picked = [vocabulary[min(int(rng.paretovariate(0.4)) - 1, len(vocabulary) - 1)] for _ in range(60)]
        rows.append((i, "1, ".join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in picked)))
    for k, count in (("abcdef", 5), ("xbcdef", 25), ("xycdef", 130), ("xyzdef", 700)):
        rows += [(1000 + j, f"{k} " * 5) for j in range(count // 5)]
    rows += [(None, "xyzdef " * 3), (5, None), (6, ""), (7, "a b c"), (8, "z" * 30_000 + " " + " ".join(["y" * 5000] * 6)), rows[0], rows[0]]
    return rows


@pytest.mark.parametrize("cell", [spelling.CELL, 60])
def test_variants_equal_brute_force(spark, spelled, cell):
    got = spelling.variants(frame(spark, spelled), cell=cell).collect()
    want = grouped(counted(spelled))
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want and len(got) == len(want)
    assert want["abcdef"][:2] == ("xbcdef", "xyzdef")


def test_variants_of_nothing(spark):
    for rows in ([], [(1, None), (2, "short words only")]):
        assert spelling.variants(frame(spark, rows)).count() == 0
