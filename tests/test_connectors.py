"""Readers, connectors, stores, ingestion runs, synchronisation and schedules on real folders."""

import hashlib
import json
import os
import subprocess
import time

import pytest
from pyspark.sql import functions as F

from quillmere.operators import ingestion_run, sync_run
from quillmere.sources import connectors, files, readers, store, transcripts
from quillmere.streaming import schedule

KEYS = {"a.md": b"alpha", "b/c.md": b"beta", "b/d/e.txt": b"\xff\xfe", "b/d/f.md": "café".encode(), "x/y/z/deep.md": b"deep", "empty.md": b""}


@pytest.fixture
def folder(tmp_path):
    for key, body in KEYS.items():
        (tmp_path / "src" / key).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / key).write_bytes(body)
    return str(tmp_path / "src")


def git(where, *args):
    return subprocess.run(["git", "-C", where, "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True, text=True).stdout


@pytest.fixture
def repository(folder):
    git(folder, "init", "-q", "-b", "main")
    os.symlink("a.md", f"{folder}/link.md")
    git(folder, "add", ".")
    git(folder, "commit", "-qm", "first")
    return folder


@pytest.mark.parametrize("tasks", [1, 3, 64])
def test_files_are_those_of_the_listing(spark, folder, tasks):
    readers.register(spark)
    rows = spark.read.format("quillmere-files").options(path=folder, content="true", tasks=tasks).load().collect()
    assert {r.external_key: bytes(r.content) for r in rows} == KEYS and len(rows) == len(KEYS)
    plain = {r.external_key: (r.bytes, r.updated_at) for r in files.probe_files(spark, folder, "c").collect()}
    assert plain == {r.external_key: (r.bytes, r.updated_at) for r in rows if r.bytes}  # Spark's own reader passes over empty files


def test_patterns_and_prefixes(spark, folder):
    readers.register(spark)
    got = lambda **o: {r.external_key for r in spark.read.format("quillmere-files").options(path=folder, **o).load().collect()}
    assert got(include="*.md") == {"a.md", "empty.md"} and got(include="**/*.md") == {k for k in KEYS if k.endswith(".md")}
    assert got(include="b/**\nx/*") == {"b/c.md", "b/d/e.txt", "b/d/f.md"} and got(prefix="b/d/") == {"b/d/e.txt", "b/d/f.md"} and got(include="b/d/?.md") == {"b/d/f.md"}


@pytest.mark.parametrize("tasks", [1, 64])
def test_blobs_of_a_ref(spark, repository, tasks):
    with open(f"{repository}/a.md", "wb") as f:
        f.write(b"changed later")
    readers.register(spark)
    rows = spark.read.format("quillmere-git").options(path=repository, ref="main", content="true", tasks=tasks).load().collect()
    assert {r.external_key: bytes(r.content) for r in rows} == KEYS
    listed = {r.external_key: (r.path_hash, r.bytes) for r in files.probe_git(spark, repository, "main", "c").collect()}
    assert listed == {r.external_key: (r.path_hash, r.bytes) for r in rows}
    for ref in ("--help", "nowhere"):
        with pytest.raises(Exception, match="no ref|git rev-parse failed"):
            spark.read.format("quillmere-git").options(path=repository, ref=ref).load().collect()


def test_connectors_of_registrations(spark, repository):
    make = connectors.from_registration
    tree = make({"connector_id": "g", "kind": "git", "options": {"repository_dir": repository, "ref": "main", "pathspecs": ["**/*.md"]}})
    found = tree.probes(spark)
    some = found.where("external_key like 'b/%'")
    assert {r.external_key: r.text for r in tree.normalised(tree.contents(spark, some)).collect()} == {"b/c.md": "beta", "b/d/f.md": "café"}
    own = make({"connector_id": "f", "kind": "files", "options": {"base_dir": repository, "patterns": ["b/**"]}})
    errors = {r.external_key: r.error for r in own.normalised(own.contents(spark, own.probes(spark))).collect()}
    assert errors == {"b/c.md": None, "b/d/f.md": None, "b/d/e.txt": "not valid UTF-8"}
    other = make({"connector_id": "f", "kind": "files", "options": {"base_dir": repository, "patterns": ["a/**"]}})
    assert own.scope_fingerprint(spark) == own.scope_fingerprint(spark) != other.scope_fingerprint(spark)
    for bad in ({"kind": "files"}, {"connector_id": "a b", "kind": "files", "options": {"base_dir": "x"}}, {"connector_id": "a", "kind": "ftp"}, {"connector_id": "a", "kind": "git"}, {"connector_id": "a", "kind": "files", "options": {"base_dir": "x", "depth": 3}}, {"connector_id": "a", "kind": "files", "options": {"base_dir": "x", "patterns": "*"}}, {"connector_id": "a", "kind": "files", "options": {"base_dir": "x", "artifact": "song"}}):
        with pytest.raises(ValueError):
            make(bad)


def line(**record):
    return json.dumps(record)


LOG = "\n".join([
    line(sessionId="s2", uuid="p", type="user", message={"b": 1}, timestamp="1"), line(sessionId="s1", uuid="a", type="user", text="first", timestamp="1"), "no json", line(sessionId="s1", uuid="x", type="user", text="other thread", timestamp="2"), "[1]",
    line(sessionId="s1", uuid="b", parentUuid="a", type="assistant", text="mail me@there.org", timestamp="3"), line(sessionId="s1", uuid="y", parentUuid="x", type="assistant", text="its answer", timestamp="2"), line(sessionId="s1", uuid="c", parentUuid="b", type="user", text="last", timestamp="9"),
    line(sessionId="s1", uuid="o", parentUuid="gone", type="user", text="orphan"), line(sessionId="s1", uuid="u", parentUuid="v", text="round"), line(sessionId="s1", uuid="v", parentUuid="u", text="about"),
])


def test_sessions_are_put_together(spark):
    rows = transcripts.sessions(spark.createDataFrame([("f", LOG), ("g", ""), ("h", line(text="alone"))], "source_id string, text string")).collect()
    s1 = [(r.text, r.depth) for r in sorted((r for r in rows if r.session == "s1"), key=lambda r: r.place)]
    assert s1 == [("first", 0), ("mail me@there.org", 1), ("last", 2), ("other thread", 0), ("its answer", 1), ("orphan", 0), ("round", 0), ("about", 0)]
    assert [(r.text, r.role) for r in rows if r.session == "s2"] == [('{"b":1}', "user")] and [r.text for r in rows if r.source_id == "h"] == ["alone"]


@pytest.mark.parametrize("n", [1, 2, 700])
def test_long_threads_take_few_rounds(spark, n):
    body = "\n".join(line(id=str(k), parent=str(k - 1), role="user", text=str(k)) for k in reversed(range(n)))
    rows = transcripts.sessions(spark.createDataFrame([("f", body)], "source_id string, text string")).orderBy("place").collect()
    assert [r.text for r in rows] == [str(k) for k in range(n)] and [r.depth for r in rows] == list(range(n))


def test_transcripts_are_always_redacted(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "s.jsonl").write_text(LOG)
    c = connectors.from_registration({"connector_id": "t", "kind": "transcripts", "options": {"base_dir": str(tmp_path / "log")}})
    for weak in (connectors.NONE, connectors.SECRETS):
        with pytest.raises(ValueError, match="needs redaction"):
            ingestion_run.run(spark, c, str(tmp_path / "out"), weak)
    done = ingestion_run.run(spark, c, str(tmp_path / "out"))
    text = store.read(spark, str(tmp_path / "out/texts")).first().text
    assert done.counters["redacted"] == 1 and "me@there.org" not in text and text.index("first") < text.index("last") < text.index("other thread") and text.startswith("## Session s1")


# --------------------------------------------------------------------------- stores


def state(place):
    return {k: sorted(os.path.relpath(os.path.join(d, n), place) for d, _, ns in os.walk(f"{place}/{k}") for n in ns) for k in ("parts", "manifests")}


def test_what_is_written_comes_back(spark, tmp_path):
    place = str(tmp_path / "s")
    rows = spark.range(1000).select("id", F.array(F.col("id").cast("double"), F.lit(None)).alias("v"), F.struct(F.col("id").cast("string").alias("t")).alias("s")).repartition(5)
    assert store.write(rows, place) == 1
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(store.read(spark, place), rows) and store.read(spark, place).schema == rows.schema
    assert store.write(rows, place, overwrite=False) == 2 and store.read(spark, place).count() == 2000 and store.read(spark, place, 1).count() == 1000
    assert store.write(rows.limit(0), place) == 3 and store.read(spark, place).count() == 0
    with pytest.raises(Exception, match="no store"):
        store.read(spark, str(tmp_path / "nowhere")).count()
    assert len(store.sweep(place, 1)) == 10 and state(place)["parts"] == [] and store.generations(place) == [3]


def test_a_killed_task_leaves_no_trace(spark, tmp_path):
    place = str(tmp_path / "s")
    store.write(spark.range(10), place)
    before = state(place)
    dies = spark.range(0, 4000, 1, 4).select(F.when(F.col("id") == 3999, F.raise_error(F.lit("killed")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="killed"):
        store.write(dies, place)
    assert state(place) == before and store.read(spark, place).count() == 10


def test_a_file_of_a_lost_attempt_is_not_read(spark, tmp_path):
    place = str(tmp_path / "s")
    writer = store.Writer({"path": place}, spark.range(1).schema, True)
    batch = spark.range(7).toArrow().combine_chunks().to_batches()
    lost, kept = writer.write(iter(batch)), writer.write(iter(batch))
    assert lost.name != kept.name and len(state(place)["parts"]) == 2
    writer.commit([kept])
    assert store.read(spark, place).count() == 7 and len(state(place)["parts"]) == 1


def test_of_two_writers_the_second_fails_whole(spark, tmp_path):
    place = str(tmp_path / "s")
    store.write(spark.range(5), place)
    store.write(spark.range(6), place, generation=1)
    before = state(place)
    with pytest.raises(Exception, match="generation"):
        store.write(spark.range(7), place, generation=1)
    assert state(place) == before and store.read(spark, place).count() == 6


def test_a_token_is_written_once_and_damage_is_found(spark, tmp_path):
    place = str(tmp_path / "s")
    for _ in range(3):
        store.write(spark.range(5), place, token="batch-1", overwrite=False)
    assert store.read(spark, place).count() == 5 and store.generations(place) == [1]
    name = state(place)["parts"][0]
    with open(f"{place}/{name}", "r+b") as f:
        f.seek(20)
        f.write(b"?")
    with pytest.raises(Exception, match="not what was written"):
        store.read(spark, place).count()


# --------------------------------------------------------------------------- ingestion runs


def test_counters_equal_a_second_count(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    with open(f"{folder}/secret.md", "w") as f:
        f.write("password = hunter22\nmail a@b.co and c@d.co")
    c = connectors.from_registration({"connector_id": "f", "kind": "files", "options": {"base_dir": folder, "project_keys": ["p"]}})
    for expected, change in (({"discovered": 7, "skipped": 0, "fetched": 6, "failed": 1, "redacted": 3}, None), ({"discovered": 7, "skipped": 6, "fetched": 0, "failed": 1, "redacted": 0}, None), ({"discovered": 6, "skipped": 4, "fetched": 1, "failed": 1, "redacted": 0}, "change")):
        if change:
            os.unlink(f"{folder}/empty.md")
            with open(f"{folder}/a.md", "w") as f:
                f.write("<h1>One</h1>text<h2>Two</h2>more")
        done = ingestion_run.run(spark, c, out)
        jobs = done.jobs.collect()
        second = {"discovered": len(jobs), **{n: sum(j.status == s for j in jobs) for n, s in (("skipped", "skipped"), ("fetched", "completed"), ("failed", "failed"))}, "redacted": sum(j.redactions for j in jobs), "bytes": sum(j.bytes for j in jobs if j.status == "completed")}
        assert done.counters == second and {k: second[k] for k in expected} == expected
    m = {r.external_key: r for r in store.read(spark, f"{out}/manifests").collect()}
    assert m["empty.md"].availability == "missing" and "b/d/e.txt" not in m and len(m) == 6 and len(m["a.md"].sections) == 2 and m["a.md"].project_keys == ["p"]
    assert m["a.md"].content_hash == hashlib.sha256(b"<h1>One</h1>text<h2>Two</h2>more").hexdigest()
    texts = {r.source_id: r.text for r in store.read(spark, f"{out}/texts").collect()}
    assert texts[m["secret.md"].source_id] == "password = [REDACTED_SECRET]\nmail [REDACTED_EMAIL] and [REDACTED_EMAIL]"


def test_a_limit_takes_the_rest_next_time(spark, folder, tmp_path):
    c, out, got = connectors.Files("f", folder, ("**/*.md",)), str(tmp_path / "out"), []
    for _ in range(3):
        got.append(ingestion_run.run(spark, c, out, limit=2).counters["fetched"])
    assert got == [2, 2, 1] and {r.availability for r in store.read(spark, f"{out}/manifests").collect()} == {"available"}
    with pytest.raises(ValueError):
        ingestion_run.run(spark, c, out, limit=-1)


class Restless(connectors.Files):
    """A source that changes while it is taken in, `times` times."""

    times = 1

    def contents(self, spark, wanted):
        out = super().contents(spark, wanted)
        if self.times:
            self.times -= 1
            rows = out.collect()
            with open(f"{self.base_dir}/a.md", "a") as f:
                f.write("more")
            return spark.createDataFrame(rows, out.schema)
        return out


@pytest.mark.parametrize(("times", "passes"), [(1, 2), (5, 4)])
def test_what_changes_between_passes_is_reported(spark, folder, tmp_path, times, passes):
    c = Restless("f", folder, ("*.md",))
    c.times = times
    rows = ingestion_run.refresh(spark, c, str(tmp_path / "out"), passes=3).collect()
    assert {r["pass"] for r in rows} == set(range(1, passes + 1)) and {r.state for r in rows if r["pass"] == 1} == {"new"}
    assert all(len([r for r in rows if r["pass"] == p]) == 1 for p in range(2, passes + 1))


# --------------------------------------------------------------------------- synchronisation


def entries(spark, **contents):
    return spark.createDataFrame([(p.replace("_", "/") + ".md", c, "team", "internal") for p, c in contents.items()], "path string, content string, visibility string, sensitivity string")


def contents(df):
    return {r.path: r.content for r in df.collect()}


def test_two_sides_meet(spark, tmp_path):
    remote = sync_run.StoreBackend(str(tmp_path / "remote"))
    none = spark.createDataFrame([], "path string, hash string, deleted boolean")
    one = sync_run.run(entries(spark, k_a="1", k_b="2"), none, remote)
    assert one.wrote and one.generation == 1 and {r.action for r in one.done.collect()} == {"push"}
    two = sync_run.run(entries(spark, k_c="3"), none, remote)
    assert contents(two.local) == {"k/a.md": "1", "k/b.md": "2", "k/c.md": "3"} and two.generation == 2
    again = sync_run.run(two.local, two.base, remote)
    assert not again.wrote and again.done.count() == 0 and remote.generation() == 2
    # the first side changes a, deletes b and adds a file that may not leave; the second changes a as well
    changed = entries(spark, k_a="1x").unionByName(entries(spark, k_s="hidden").withColumn("visibility", F.lit("private")))
    three = sync_run.run(changed, one.base, remote)
    assert {(r.path, r.action) for r in three.done.collect()} == {("k/a.md", "push"), ("k/b.md", "delete_remote"), ("k/c.md", "pull")}
    four = sync_run.run(entries(spark, k_a="1y", k_b="2", k_c="3"), again.base, remote)
    assert {(r.path, r.action) for r in four.done.collect()} == {("k/a.md", "conflict"), ("k/b.md", "delete_local")} and contents(four.local) == {"k/a.md": "1y", "k/c.md": "3"}
    assert not any("hidden" == r.content for r in remote.entries(spark).collect())


def test_a_remote_that_moved_on_changes_nothing(spark, tmp_path):
    class Late(sync_run.StoreBackend):
        def commit(self, entries, generation, token):
            store.write(store.read(spark, self.path), self.path)  # another commits first
            return super().commit(entries, generation, token)

    none = spark.createDataFrame([], "path string, hash string, deleted boolean")
    sync_run.run(entries(spark, k_a="1"), none, sync_run.StoreBackend(str(tmp_path / "r")))
    with pytest.raises(Exception, match="generation"):
        sync_run.run(entries(spark, k_b="2"), none, Late(str(tmp_path / "r")))
    assert contents(store.read(spark, str(tmp_path / "r"))) == {"k/a.md": "1"}


def test_scheduled_runs_go_on_after_a_restart(spark, tmp_path):
    local, base, remote = (str(tmp_path / n) for n in ("local", "base", "remote"))
    backend, ticks = sync_run.StoreBackend(remote), str(tmp_path / "ticks")
    store.write(entries(spark, k_a="1"), local)
    first = schedule.sync_every(spark, 1, ticks, local, base, backend)
    assert first.wait(2, 60)
    first.stop()
    assert remote and backend.generation() == 1 and all(e is None for _, e in first.runs)
    store.write(entries(spark, k_a="mine"), local)
    theirs = backend.entries(spark).withColumn("content", F.lit("theirs")).withColumn("hash", F.sha2(F.lit("theirs"), 256))
    store.write(theirs, remote)
    second = schedule.sync_every(spark, 1, ticks, local, base, backend)
    assert second.wait(2, 60)
    second.stop()
    numbers = [n for n, _ in first.runs + second.runs]
    assert sorted(set(numbers)) == list(range(max(numbers) + 1)) and contents(store.read(spark, local)) == {"k/a.md": "mine"} and contents(store.read(spark, remote)) == {"k/a.md": "theirs"} and backend.generation() == 2


def test_a_run_broken_off_after_its_push_is_not_pushed_twice(spark, tmp_path):
    backend = sync_run.StoreBackend(str(tmp_path / "r"))
    none = spark.createDataFrame([], "path string, hash string, deleted boolean")
    sync_run.run(entries(spark, k_a="1"), none, backend, token="7")  # its base is lost
    again = sync_run.run(entries(spark, k_a="1"), none, backend, token="7")
    assert not again.wrote and backend.generation() == 1 and {(r.path, r.deleted) for r in again.base.collect()} == {("k/a.md", False)}


def test_an_error_is_reported_and_the_next_run_comes(spark, tmp_path):
    seen = []

    def work(number):
        if number == 0:
            raise RuntimeError("once")

    s = schedule.every(spark, 0.3, str(tmp_path / "t"), work, on_error=lambda n, e: seen.append((n, str(e))))
    assert s.wait(3, 40)
    s.stop()
    assert seen == [(0, "once")] and [e for _, e in s.runs][:3] == ["RuntimeError: once", None, None]
    stopped = schedule.every(spark, 0.3, str(tmp_path / "u"), work, should_stop=lambda: True)
    time.sleep(2)
    stopped.stop()
    assert stopped.runs == []
    with pytest.raises(ValueError):
        schedule.every(spark, 0, str(tmp_path / "v"), work)
