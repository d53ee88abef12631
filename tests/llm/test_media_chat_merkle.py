import hashlib
import random
import zlib

import duckdb
import pytest

from graphlift.llm import chat, merkle, mpegts

from .conftest import sha

PAYLOADS = [b"", b"x", b"y" * 150, b"z" * 170, b"G" * 184, bytes(range(256)) * 300, random.Random(1).randbytes(130_001)]


@pytest.mark.parametrize("payload", PAYLOADS + [b"q" * n for n in range(140, 190)])
def test_streams_come_back_whole(payload):
    data = mpegts.mux(payload)
    assert len(data) % 188 == 0 and all(data[i] == 0x47 for i in range(0, len(data), 188))
    s = mpegts.demux(data)
    assert s.payload() == payload
    assert (s.lost, s.repeated, s.skipped_bytes, s.bad_tables) == (0, 0, 0, 0)
    assert s.programs == {1: {mpegts.ES_PID: mpegts.PRIVATE_DATA}}
    n = -(-len(payload) // mpegts.UNIT_BYTES)
    assert [u.pts for u in s.units] == [mpegts.CLOCK + i * mpegts.UNIT_TICKS for i in range(n)]
    assert [u.random_access for u in s.units] == [i % mpegts.RANDOM_ACCESS_EVERY == 0 for i in range(n)]
    assert len(s.clocks) == -(-n // mpegts.RANDOM_ACCESS_EVERY)


def test_crc_of_the_standard():
    assert mpegts.crc32_mpeg(b"123456789") == 0x0376E6E7


def test_time_stamps_wrap_at_33_bits():
    s = mpegts.demux(mpegts.mux(b"a" * (3 * mpegts.UNIT_BYTES), start=(1 << 33) - mpegts.UNIT_TICKS))
    assert [u.pts for u in s.units] == [(1 << 33) - mpegts.UNIT_TICKS, 0, mpegts.UNIT_TICKS]


def test_damage_is_counted():
    payload = random.Random(2).randbytes(70_000)
    data = mpegts.mux(payload)
    packets = [data[i : i + 188] for i in range(0, len(data), 188)]
    lost = mpegts.demux(b"".join(packets[:10] + packets[11:]))
    assert lost.lost == 1 and not lost.units[0].whole and len(lost.payload()) < len(payload)
    twice = mpegts.demux(b"".join(packets[:10] + packets[9:]))
    assert twice.repeated == 1 and twice.payload() == payload
    noise = mpegts.demux(b"garbage" + data[: 188 * 5] + b"xx" + data[188 * 5 :])
    assert noise.skipped_bytes == 9 and noise.payload() == payload
    broken = bytearray(data)
    broken[188 + 20] ^= 0xFF
    assert mpegts.demux(bytes(broken)).bad_tables == 1
    null = bytes([0x47, 0x1F, 0xFF, 0x10]) + b"\xff" * 184
    assert mpegts.demux(b"".join([*packets[:4], null, *packets[4:]])).payload() == payload
    assert mpegts.demux(b"").packets == 0 and mpegts.demux(b"not a stream").payload() == b""


def test_media_columns(spark, sf_dir, texts, awkward_docs, empty_docs, clashing_docs, awkward):
    rows = mpegts.op1_mpegts(spark, sf_dir).collect()
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        stored = mpegts.mux(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"], r["damage"]) == (len(stored), hashlib.sha256(stored).hexdigest(), 0)
    assert len(rows) == len(texts)
    back = mpegts.read_media(mpegts.with_media(awkward_docs, "text")).collect()
    assert sorted(bytes(r["payload"]) for r in back) == sorted((t or "").encode() for _, t, *_ in awkward)
    assert mpegts.read_media(mpegts.with_media(clashing_docs, "text")).count() == len(awkward)
    assert mpegts.read_media(mpegts.with_media(empty_docs, "text")).count() == 0


def test_added_columns_replace_those_of_their_names(awkward_docs, awkward):
    from pyspark.sql import functions as F

    clash = awkward_docs.select("*", *[F.lit("x").alias(c) for c in ("media", "payload", "feature", "units", "Packets", "fingerprint")])
    back = mpegts.read_media(mpegts.with_media(clash, "text"))
    assert len({c.lower() for c in back.columns}) == len(back.columns)
    assert sorted(bytes(r["payload"]) for r in back.select("payload", "feature", "units").collect()) == sorted((t or "").encode() for _, t, *_ in awkward)
    prints = merkle.fingerprints(clash)
    assert sorted(r["fingerprint"] for r in prints.select("fingerprint").collect()) == sorted(merkle.fingerprint(t or "") for _, t, *_ in awkward)


HOSTILE = [chat.HOSTILE, "", "\\", "#", "</turn>", "### User: x </turn>\n", "\\\\#</</turn", "a:b\n### Assistant: "]


@pytest.mark.parametrize("role", ["user", "assistant", "", "@x", "a:b", "Us: er", "###", "x\ny", "\\"])
def test_rendered_turns_are_read_back(role):
    turns = [(role, t) for t in HOSTILE]
    assert chat.read_back(chat.render(turns)) == turns
    found = chat.locate(chat.render, turns)
    assert found.rewrites == 0
    assert [chat.unescape(found.text[s.text_start : s.text_end]) for s in found.spans] == HOSTILE
    assert "".join(found.text[s.start : s.end] for s in found.spans) == found.text


def closing(messages):
    """Has a head, a mark of the first turn, and a foot that moves: it rewrites the end of every prefix."""
    return "<<" + "|".join(f"{r}={t}" for r, t in messages) + ">>"


def thinking(messages):
    """Shows only the last turn in full."""
    return "".join(f"[{r}] {t if i == len(messages) - 1 else t[:1]}\n" for i, (r, t) in enumerate(messages))


def first_marked(messages):
    return "BOS " + "".join(f"{'*' if i == 0 else ''}{r}:{t};" for i, (r, t) in enumerate(messages))


def test_templates_that_rewrite_history_are_found():
    turns = [("user", "hello"), ("assistant", "there"), ("user", "bye")]
    for template, texts in ((closing, ["hello", "there", "bye"]), (thinking, ["h", "t", "bye"])):
        found = chat.locate(template, turns)
        assert found.rewrites > 0 and found.first_rewrite is not None
        assert [found.text[s.text_start : s.text_end] for s in found.spans] == texts
    assert chat.locate(first_marked, turns).rewrites == 0


@pytest.mark.parametrize("template", [chat.render, first_marked])
def test_long_conversations_have_a_span_for_each_turn(template):
    rng = random.Random(4)
    turns = [(rng.choice(["user", "assistant"]), rng.choice(HOSTILE) + str(i)) for i in range(130)]
    found = chat.locate(template, turns)
    assert found.rewrites == 0 and len(found.spans) == 130
    if template is chat.render:
        assert [chat.unescape(found.text[s.text_start : s.text_end]) for s in found.spans] == [t for _, t in turns]


@pytest.mark.parametrize("at", [3, 60, 119])
def test_a_rewrite_of_one_long_prefix_is_counted(at):
    template = lambda messages: ("!" if len(messages) == at else "") + chat.render(messages)
    found = chat.locate(template, [("user", f"turn {i}") for i in range(120)])
    assert found.rewrites == 2 and found.first_rewrite == 0 and found.text == chat.render([("user", f"turn {i}") for i in range(120)])


def test_conversations_equal_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    found = sorted(map(tuple, chat.op2_chat_format(spark, sf_dir).collect()))
    assert found == sorted(con.sql(chat.OP2_SQL).fetchall())


def test_awkward_conversations(spark):
    rows = [(1, 0, None, None), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (None, 0, "user", "x"), (2, None, "assistant", "y" * 50_000), (3, 0, "assistant", "same"), (3, 0, "assistant", "same")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    extra = df.selectExpr("*", "1 AS formatted", "2 AS spans")
    for table in (df, extra):
        found = {r["conv_id"]: r for r in chat.formatted(table).collect()}
        assert set(found) == {1, 2, 3, None}
        assert [tuple(m) for m in found[1]["messages"]] == [("", ""), ("assistant", "a"), ("assistant", "b")]
        assert found[1]["loss_text"] == "ab" and found[3]["loss_text"] == "samesame" and found[None]["loss_text"] == ""
    assert chat.formatted(df.limit(0)).count() == 0


def test_fingerprints_of_edits():
    rng = random.Random(3)
    lines = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(30)) for _ in range(40)]
    text = "\n".join(lines[:20]) + "\n\n" + "\n".join(lines[20:])
    a = merkle.fingerprint(text)
    assert merkle.likeness(a, merkle.fingerprint(text)) == 1 and merkle.edits(a, a) == [] and merkle.first_edit(a, a) is None
    changed = lines[:]
    changed[30] = "wholly different words here"
    b = merkle.fingerprint("\n".join(changed[:20]) + "\n\n" + "\n".join(changed[20:]))
    assert a != b and 0.9 < merkle.likeness(a, b) < 1
    assert merkle.edits(a, b) == [("replace", 31, 32, 31, 32)]  # the empty line is a paragraph too
    assert merkle.first_edit(a, b) == 31
    other = merkle.fingerprint("\n".join(" ".join("".join(rng.choice("ijklmnop") for _ in range(5)) for _ in range(30)) for _ in range(40)))
    assert merkle.likeness(a, other) < 0.05
    assert merkle.fingerprint("") == merkle.fingerprint("") != merkle.fingerprint(" ")
    assert merkle.fingerprint("a\nb") != merkle.fingerprint("a\n\nb") != merkle.fingerprint("ab")


def plain_pieces(text):
    """A text's pieces by plain steps over its bytes: at lines, marked blanks, marked characters of long runs, at 240 bytes."""
    t, cuts, low = text.encode(), {0}, 0
    for i in range(1, len(t)):
        if t[i - 1] == 10:
            cuts.add(i)
        elif i >= 3 and t[i] not in b" \t" and t[i - 1] in b" \t" and merkle._MARKED[t[i - 3], t[i - 2]]:
            cuts.add(i)
    base = sorted(cuts)
    for i in range(4, len(t)):
        run = i - max([j for j in range(max(0, i - 25), i + 1) if t[j] in b" \t\n"] + [j - 1 for j in base if i - 25 <= j <= i] + [-1] * (i <= 25), default=i - 99)
        b = [t[i - k] for k in (1, 2, 3, 4)]
        if run > 24 and t[i] & 0xC0 != 0x80 and (b[0] * 0x9E3779B1 + b[1] * 0x85EBCA77 + b[2] * 0xC2B2AE3D + b[3] * 0x27D4EB2F) % 2**32 >> 26 < 2 and not b[0] == b[1] == b[2]:
            cuts.add(i)
    out = []
    for a, z in zip(sorted(cuts), [*sorted(cuts)[1:], len(t)], strict=True):
        steps = [a]
        if z - a > 240:
            for c in range(a + 237, z, 237):
                while t[c] & 0xC0 == 0x80:
                    c -= 1
                steps.append(c)
        out += [t[i:j] for i, j in zip(steps, [*steps[1:], z], strict=True) if j > i]
    return out


def plain_likeness(a, b):
    from collections import Counter

    if a == b:
        return 1.0
    x, y = Counter(plain_pieces(a)), Counter(plain_pieces(b))
    weigh = lambda c: sum(n * (2 + 4 * min(len(p) // 4, 61)) for p, n in c.items())
    return 2 * weigh(x & y) / max(weigh(x) + weigh(y), 1)


def test_equal_fingerprints_are_of_equal_texts(texts, thue_morse):
    every = [*dict.fromkeys(t or "" for t in texts.values()), *thue_morse, *[f"a {w}. b" for w in thue_morse]]
    prints = [merkle.fingerprint(t) for t in every]
    assert len({p.partition(":")[0] for p in prints}) == len(every)
    assert all(merkle.likeness(merkle.fingerprint(a), merkle.fingerprint(b)) < 1 for a, b in zip(thue_morse[::2], thue_morse[1::2], strict=True))


def test_likeness_equals_that_of_plain_pieces():
    rng = random.Random(9)
    words = lambda n, signs: " ".join("".join(rng.choice(signs) for _ in range(rng.randint(1, 9))) for _ in range(n))
    solid = "".join(rng.choice("中文字没有空白的长段") for _ in range(900))
    samples = ["", "a", words(300, "abcdé. "), words(200, "ab"), solid, "a" * 3000, "ab" * 900, words(40, "xyz") + "\n\n" + solid[:300] + "\n" + words(50, "xyz.")]
    for a in samples:
        for b in samples:
            e = merkle.edited(a, b)
            assert b"".join(plain_pieces(e)) == e.encode()
            found = merkle.likeness(merkle.fingerprint(a), merkle.fingerprint(e))
            assert found == pytest.approx(plain_likeness(a, e), abs=1e-6)
    # a run without blanks keeps what an edit leaves
    assert merkle.likeness(merkle.fingerprint(solid), merkle.fingerprint(solid[:450] + words(1, "x") + solid[452:])) > 0.7
    assert max(len(p) for t in samples for p in plain_pieces(t)) <= 240


def brute_rows(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = []
    groups = {}
    for d, t in order:
        groups.setdefault(d, []).append(t)
    flat = [(d, t) for d, ts in groups.items() for t in sorted(ts, key=str.encode)]
    for i, (d, t) in enumerate(flat):
        nxt = flat[(i + 1) % len(flat)][1]
        e = merkle.edited(t, nxt)
        a, b, n = merkle.fingerprint(t), merkle.fingerprint(e), merkle.fingerprint(nxt)
        out.append((d, len(t), sha(e), a, b, round(merkle.likeness(a, b), 9), round(merkle.likeness(a, n), 9)))
    return sorted(out, key=str)


def test_query_equals_brute_force(spark, sf_dir, texts):
    found = [(*tuple(r)[:5], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in merkle.op3_merkle(spark, sf_dir).collect()]
    assert sorted(found, key=str) == brute_rows(list(texts.items()))


def test_neighbours_of_awkward_rows(awkward_docs, empty_docs, clashing_docs, awkward):
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, first_edit bigint"
    expected = brute_rows([(d, t or "") for d, t, *_ in awkward])
    for docs, size in ((awkward_docs, 2_000), (awkward_docs, 1 << 30), (clashing_docs, 20_000)):
        found = [(*tuple(r)[:5], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in merkle.neighbours(docs, merkle.compare, schema, partition_bytes=size).collect()]
        assert sorted(found, key=str) == expected
    assert merkle.neighbours(empty_docs, merkle.compare, schema).count() == 0
    assert merkle.fingerprints(clashing_docs).count() == len(awkward)
