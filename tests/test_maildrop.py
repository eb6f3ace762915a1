import base64
import json
import random

from mailsift.functions import mime
from mailsift.sources import listings, maildrop


def b64(data):
    raw = data.encode() if isinstance(data, str) else data
    return base64.urlsafe_b64encode(raw).decode()


def message(mid, title="untitled", origin="desk@corp.test", **payload):
    """A landed mail with one plain part, unless ``payload`` says otherwise."""
    shape = dict(mimeType="text/plain", body={}, parts=[])
    shape["headers"] = [dict(name=n, value=v) for n, v in (("Subject", title), ("From", origin))]
    return dict(id=mid, payload=shape | payload)


def parsed(spark, *messages):
    rows = [(i, m if isinstance(m, str) else json.dumps(m)) for i, m in enumerate(messages)]
    return maildrop.parse(spark.createDataFrame(rows, "pos long, raw string"))


def rows(spark, *messages):
    return parsed(spark, *messages).orderBy("pos").collect()


def listed(spark, *ids):
    return spark.createDataFrame(list(enumerate(ids)), "pos long, gmail_id string")


def test_list_decides_order_length_and_members(spark):
    mail = parsed(spark, *[message(f"inbox-{n}", f"note {n}") for n in (40, 7, 23, 99)])
    listing = listed(spark, "inbox-23", "inbox-7", "gone", "inbox-40", "inbox-99")
    out = maildrop.fetch_recent(listing, mail, 4).collect()
    assert [(r["gmail_id"], r["subject"]) for r in out] == [
        ("inbox-23", "note 23"), ("inbox-7", "note 7"), ("inbox-40", "note 40"),
    ]
    assert maildrop.fetch_recent(listing, mail, 1).count() == 1
    assert maildrop.fetch_recent(listed(spark, "gone"), mail, 5).count() == 0


def test_landed_files_are_read_as_rows(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join(json.dumps(message(f"m{i}")) for i in range(3)))
    out = maildrop.parse(maildrop.read_landed(spark, str(tmp_path))).collect()
    assert sorted(r["gmail_id"] for r in out) == ["m0", "m1", "m2"]


def test_headers(spark):
    m = message("m")
    m["payload"]["headers"] = [
        {"name": "FROM", "value": "first"}, {"name": "from", "value": "second"}, {"value": "x"}, {"name": "Date"},
    ]
    bare = {"id": "n", "payload": {}}
    first, second = rows(spark, m, bare)
    assert (first["sender"], first["subject"]) == ("first", "")
    assert (second["sender"], second["body"], second["attachment"], second["reject"]) == ("", "", "", None)


def nested(levels):
    part = {"mimeType": "text/plain", "body": {"data": b64(f"level {levels}")}}
    for _ in range(levels):
        part = {"mimeType": "multipart/mixed", "parts": [part]}
    return part


def test_first_plain_part_in_pre_order(spark):
    tree = {
        "mimeType": "multipart/mixed",
        "parts": [
            {"mimeType": "text/html", "body": {"data": b64("<b>html</b>")}},
            {"mimeType": "multipart/alternative", "filename": "outer.txt", "parts": [
                {"mimeType": "text/plain", "body": {"data": ""}},
                {"mimeType": "text/plain", "body": {"data": b64("\n 첫 본문 \n")}, "filename": "inner.txt"},
            ]},
            {"mimeType": "text/plain", "body": {"data": b64("later")}, "filename": "last.txt"},
        ],
    }
    row = rows(spark, message("m", **tree))[0]
    assert row["body"] == "첫 본문"
    assert row["attachment"] == "outer.txt inner.txt last.txt"


def test_top_level_body_is_the_fallback(spark):
    row = rows(spark, message("m", mimeType="text/html", body={"data": b64(" top ")}))[0]
    assert row["body"] == "top"


def test_bytes_that_are_not_utf8_are_dropped(spark):
    kept = "a�b".encode()
    broken, valid, both, nothing = rows(
        spark,
        message("a", body={"data": b64(b"ab\xff\xfec\xe1")}),
        message("b", body={"data": b64(kept)}),
        message("c", body={"data": b64(kept + b"\xff")}),
        message("d", body={"data": b64(b"\xff\xfe")}),
    )
    assert broken["body"] == "abc"
    assert valid["body"] == both["body"] == "a�b"
    assert nothing["body"] == ""


def test_base64_without_padding_or_with_breaks(spark):
    got = rows(
        spark,
        message("a", body={"data": b64("hello").rstrip("=")}),
        message("b", body={"data": "aGVs\r\nbG8="}),
        message("c", body={"data": "aG!Vsb*G8="}),
        message("d", body={"data": "a"}),
        message("e", mimeType="x/y", parts=[
            {"mimeType": "text/plain", "body": {"data": b64("good")}},
            {"mimeType": "text/plain", "body": {"data": "a"}},
        ]),
    )
    assert [r["body"] for r in got] == ["hello", "hello", "hello", "", "good"]
    assert [r["reject"] for r in got] == [None, None, None, "bad base64", None]


def test_mail_of_any_depth_is_read(spark):
    depths = [0, mime.DEPTH, mime.DEPTH + 1, 2 * mime.DEPTH + 1, 40, 300]
    got = rows(spark, *[message(f"m{n}", **nested(n)) for n in depths])
    assert [(r["body"], r["reject"]) for r in got] == [(f"level {n}", None) for n in depths]


def test_parts_below_a_pass_keep_their_place(spark):
    """Pre-order over passes: what lies deep in an early part comes before a shallow later one."""
    deep = nested(mime.DEPTH + 3)
    deep["filename"] = "first.txt"
    below = deep
    while below.get("parts"):
        below = below["parts"][0]
    below["filename"] = "deep.txt"
    shallow = {"mimeType": "text/plain", "filename": "last.txt", "body": {"data": b64("later")}}
    row = rows(spark, message("m", mimeType="multipart/mixed", parts=[deep, shallow]))[0]
    assert (row["body"], row["attachment"]) == (f"level {mime.DEPTH + 3}", "first.txt deep.txt last.txt")


def test_deep_rows_keep_their_rejects(spark):
    part = nested(mime.DEPTH + 2)
    below = part
    while below.get("parts"):
        below = below["parts"][0]
    below["body"]["data"] = "a"
    bad, unnamed = rows(spark, message("b", **part), {"payload": nested(20)})
    assert (bad["reject"], unnamed["reject"], unnamed["body"]) == ("bad base64", "no id", "level 20")


def test_nesting_beyond_the_reader_is_malformed(spark):
    raw = '{"id":"m","payload":' + '{"parts":[' * 2000 + "]}" * 2000 + "}"
    assert [(r["gmail_id"], r["reject"]) for r in rows(spark, raw, message("n"))] == [(None, "malformed"), ("n", None)]


def test_only_wanted_responses_are_parsed(spark):
    sent = [message("a"), message("b"), message("a", "again"), '{"id": "c", "payl', '{"id": "d", "payl', "nonsense"]
    raw = spark.createDataFrame([(i, m if isinstance(m, str) else json.dumps(m)) for i, m in enumerate(sent)], "pos long, raw string")
    mail, rejects = maildrop.fetch_landed(listed(spark, "c", "a"), raw, 2)
    assert [(r["gmail_id"], r["subject"]) for r in mail.collect()] == [("a", "again")]
    assert {r["pos"] for r in rejects.collect()} <= {3}


def pages(spark, *chain):
    """(listing, token, ids, next) rows as landed pages."""
    raw = [
        (i, json.dumps({"listing": li, "pageToken": t, "messages": [{"id": x} for x in ids], "nextPageToken": n}))
        for i, (li, t, ids, n) in enumerate(chain)
    ]
    ranked, rejects = listings.rank_pages(listings.parse_pages(spark.createDataFrame([*raw, (99, "no page")], "landed long, raw string")))
    order = [(r["listing"], r["pos"], r["gmail_id"]) for r in listings.listed_ids(ranked).orderBy("listing", "pos").collect()]
    return order, sorted((r["listing"], r["token"], r["reject"]) for r in rejects.collect())


def test_pages_follow_their_tokens(spark):
    rng = random.Random(2)
    names = [f"t{i}" for i in range(37)]
    chain = [("x", ([None, *names])[i], [f"m{i}.{k}" for k in range(i % 4)], (names + [None])[i]) for i in range(38)]
    want = [x for page in chain for x in page[2]]
    rng.shuffle(chain)
    order, rejects = pages(spark, *chain, ("y", None, ["only"], ""))
    assert order == [("x", i, m) for i, m in enumerate(want)] + [("y", 0, "only")]
    assert rejects == []


def test_broken_chains_are_rejected(spark):
    order, rejects = pages(
        spark,
        ("gap", None, ["a"], "1"), ("gap", "2", ["c"], None),
        ("ring", None, ["a"], "1"), ("ring", "1", [], "2"), ("ring", "2", [], "1"),
        ("headless", "1", ["a"], None),
        ("own", "1", ["a"], "1"), ("own", None, ["z"], None),
        ("joined", None, ["a"], "1"), ("joined", "stray", ["s"], "1"), ("joined", "1", ["b"], None),
        ("again", None, ["old"], None), ("again", None, ["new"], None),
    )
    assert order == [("again", 0, "new"), ("gap", 0, "a"), ("joined", 0, "a"), ("joined", 1, "b"), ("own", 0, "z")]
    assert rejects == [
        ("gap", "1", "page missing"), ("gap", "2", "not reached"), ("headless", "1", "not reached"),
        ("joined", "stray", "not reached"), ("own", "1", "not reached"),
        ("ring", "", "ring"), ("ring", "1", "ring"), ("ring", "2", "ring"),
    ]


def test_no_pages(spark):
    assert pages(spark) == ([], [])


def test_malformed_rows_go_to_the_rejects(spark):
    mail, rejects = maildrop.split_rejects(parsed(spark, message("a"), '{"id": "b", "payl', "", '{"payload":{}}'))
    assert [r["gmail_id"] for r in mail.collect()] == ["a"]
    assert sorted((r["pos"], r["reject"]) for r in rejects.collect()) == [
        (1, "malformed"), (2, "malformed"), (3, "no id"),
    ]
