import hashlib
import json

from gradus.sources import contracts as V
from gradus.sources import files, packs

GOOD = {"example_id": "a", "proxy_output_protocol": "v2", "proxy_prompt_source_sha256": "p", "reason_text": None, "format_errors": ["e"], "prompt_token_sha256": "0" * 64}
HEAD = {"mode": "prepare", "status": "completed", "proxy_output_protocol": "v2", "proxy_prompt_source_sha256": "p", "selected_ids": ["a", "b"], "selected_count": 2}


def problems(spark, folder, rows, head):
    """The rules that a pack and its manifest break, both read from files."""
    folder.mkdir()
    pack = folder / "pack.jsonl"
    pack.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))
    if isinstance(head, dict):
        head = {"tokenpack_sha256": hashlib.sha256(pack.read_bytes()).hexdigest()} | head
    (folder / "manifest.json").write_text(head if isinstance(head, str) else json.dumps(head))
    label = "'k' AS label"
    lines = V.parsed(V.lines(spark, str(pack))).selectExpr(label, "line - 1 AS place", "doc")
    manifests = V.parsed(spark.read.text(str(folder / "manifest.json"), wholetext=True), "value").selectExpr(label, "doc")
    digests = files.digests(files.listing(spark, str(pack))).selectExpr(label, "sha256")
    heads, ids = packs.told(manifests)
    found = packs.protocol_problems(lines, digests, heads, ids, "v2", "p").collect()
    assert all(r["label"] == "k" for r in found)
    return sorted(((r["place"], r["rule"]) for r in found), key=lambda x: (x[0] is not None, x))


def test_protocol(spark, tmp_path):
    second = GOOD | {"example_id": "b", "reason_text": "why", "format_errors": []}
    assert problems(spark, tmp_path / "good", [GOOD, second], HEAD) == []
    got = problems(spark, tmp_path / "order", [second, GOOD], HEAD)
    assert got == [(0, "id is the manifest's at its place"), (1, "id is the manifest's at its place")]
    got = problems(spark, tmp_path / "short", [GOOD], HEAD)
    assert got == [(None, "manifest has the number of rows"), (1, "id is the manifest's at its place")]
    head = HEAD | {"mode": "run", "proxy_output_protocol": "v1", "proxy_prompt_source_sha256": 5, "tokenpack_sha256": "0", "selected_count": "2"}
    assert [r for _, r in problems(spark, tmp_path / "head", [GOOD, second], head)] == ["manifest has the number of rows", "manifest has the prompts' digest", "manifest has the version", "manifest is of a completed preparation", "pack has the manifest's digest"]
    bad = [{k: v for k, v in GOOD.items() if k != "reason_text"}, GOOD | {"reason_text": 1}, GOOD | {"format_errors": "e"}, GOOD | {"format_errors": ["e", None]}, GOOD | {"prompt_token_sha256": "0" * 64 + "\n"}, GOOD | {"prompt_token_sha256": "A" * 64}, GOOD | {"proxy_output_protocol": None}, "no JSON"]
    got = problems(spark, tmp_path / "rows", bad, HEAD | {"selected_ids": ["a"] * 8, "selected_count": 8})
    rules = ["reason_text is text or null", "reason_text is text or null", "format_errors are texts", "format_errors are texts", "prompt digest is SHA-256", "prompt digest is SHA-256", "row has the version"]
    assert [x for x in got if x[0] < 7] == list(enumerate(rules)) and len([x for x in got if x[0] == 7]) == 6


def test_without_rows_or_manifest(spark, tmp_path):
    """A manifest that is no JSON breaks every rule of the whole, as one that isn't there; so do ids that are no list."""
    whole = ["manifest has the number of rows", "manifest has the prompts' digest", "manifest has the version", "manifest is of a completed preparation", "pack has the manifest's digest"]
    got = problems(spark, tmp_path / "none", [GOOD], "{")
    assert got == [(None, r) for r in whole] + [(0, "id is the manifest's at its place")]
    assert problems(spark, tmp_path / "list", [GOOD], HEAD | {"selected_ids": "a", "selected_count": 1}) == [(0, "id is the manifest's at its place")]
    empty = spark.createDataFrame([], "label string, place long, raw string")
    heads, ids = packs.told(V.parsed(empty).select("label", "doc"))
    assert packs.protocol_problems(V.parsed(empty), empty.selectExpr("label", "raw AS sha256"), heads, ids, "v2", "p").count() == 0
