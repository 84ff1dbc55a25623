from datetime import datetime

import pytest

from nearfield.operators import maintenance as M
from nearfield.session import scratch_path
from nearfield.sources import sinks
from nearfield.streaming import queues
from nearfield.streaming.upkeep import Upkeep, drain_now

CHANGE = "image_id long, category_id int, op string, ts timestamp"


def at(day):
    return datetime(2024, 1, day)


@pytest.fixture
def feed(spark, make):
    """A folder of change files, a way to add one, and its stream."""
    folder = scratch_path(spark, "changes")

    def add(rows):
        make(rows, CHANGE).coalesce(1).write.mode("append").parquet(folder)

    def stream():
        return spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).parquet(folder)

    return folder, add, stream


def test_streamed_queues_equal_batch_queues(spark, feed, catalog):
    folder, add, stream = feed
    add([(1, None, "UPDATE", at(3)), (2, None, "DELETE", at(5)), (7, 2, "DELETE", at(6))])
    add([(1, None, "UPDATE", at(2)), (2, None, "DELETE", at(4)), (3, None, "INSERT", at(1))])
    changes = spark.read.parquet(folder)
    out = scratch_path(spark, "queue")

    stale = queues.stream_recompute_queue(stream(), catalog["images"])
    queues.write_queue(stale, f"{out}/a", f"{out}/ca").awaitTermination()
    expected = M.recompute_queue(changes, catalog["images"])
    assert set(queues.read_recompute_queue(spark, f"{out}/a").collect()) == set(expected.collect())

    doomed = queues.stream_deletion_queue(stream())
    queues.write_queue(doomed, f"{out}/b", f"{out}/cb").awaitTermination()
    assert set(queues.read_deletion_queue(spark, f"{out}/b").collect()) == set(M.deletion_queue(changes).collect())


def shown(state):
    return {
        "prototypes": {r.category_id: r.prototype for r in state["prototypes"].collect()},
        "pending": sorted(r.category_id for r in state["recompute_queue"].collect()),
        "queued": sorted(r.image_id for r in state["deletion_queue"].collect()),
        "removed": sorted(r.image_id for r in state["removed"].collect()),
        "indexes": sorted((r.index_id, r.ntotal) for r in state["indexes"].collect()),
    }


def start(spark, catalog, **options):
    folder = scratch_path(spark, "upkeep")
    sinks.write_catalog(catalog, f"{folder}/catalog")
    return Upkeep(f"{folder}/catalog", f"{folder}/state", **{"rebuild": True, **options}), f"{folder}/checkpoint"


def test_upkeep_over_several_batches(spark, feed, catalog):
    _, add, stream = feed
    upkeep, checkpoint = start(spark, catalog)
    add([(1, 1, "DELETE", at(2)), (3, 2, "UPDATE", at(2))])
    first = shown(drain_now(stream(), upkeep, checkpoint))
    assert first == {
        "prototypes": {1: [0.0, 1.0], 2: [4.0, 0.0], 3: [7.0, 7.0]}, "pending": [], "queued": [],
        "removed": [1], "indexes": [(1, 3), (2, 2)],
    }
    # Item 1 comes back; item 3, the only one of category 2, goes.
    add([(1, 1, "INSERT", at(3)), (3, 2, "DELETE", at(3))])
    second = shown(drain_now(stream(), upkeep, checkpoint))
    assert second == {
        "prototypes": {1: [0.5, 0.5], 2: [4.0, 0.0], 3: [7.0, 7.0]}, "pending": [2], "queued": [],
        "removed": [3], "indexes": [(1, 3), (2, 2), (3, 2)],
    }
    # A replayed batch changes nothing.
    last = upkeep.last_batch(spark)
    upkeep.process(spark.createDataFrame([(1, 1, "INSERT", at(3)), (3, 2, "DELETE", at(3))], CHANGE), last)
    again = {t: upkeep.read(spark, t, last) for t in ("prototypes", "recompute_queue", "deletion_queue", "indexes", "removed")}
    assert shown(again) == second


def test_halves_can_be_switched_off(spark, feed, catalog):
    _, add, stream = feed
    add([(1, 1, "DELETE", at(2))])
    upkeep, checkpoint = start(spark, catalog, process_prototypes=False)
    kept = shown(drain_now(stream(), upkeep, checkpoint))
    assert kept["pending"] == [1] and kept["queued"] == [] and kept["prototypes"][1] == [0.5, 0.5]
    upkeep, checkpoint = start(spark, catalog, process_deletions=False)
    kept = shown(drain_now(stream(), upkeep, checkpoint))
    assert kept["pending"] == [] and kept["queued"] == [1, 9] and kept["indexes"] == [(1, 3)]


def test_recording_deletions_without_a_rebuild(spark, feed, catalog):
    _, add, stream = feed
    add([(1, 1, "DELETE", at(2))])
    upkeep, checkpoint = start(spark, catalog, rebuild=False)
    kept = shown(drain_now(stream(), upkeep, checkpoint))
    assert kept["queued"] == [] and kept["removed"] == [1] and kept["indexes"] == [(1, 3)]


def test_prototypes_from_vectors_stored_by_category(spark, feed, catalog):
    _, add, stream = feed
    add([(1, 1, "DELETE", at(2)), (3, 2, "UPDATE", at(2))])
    members = scratch_path(spark, "members")
    sinks.write_members(catalog["vectors"], catalog["images"], members)
    upkeep, checkpoint = start(spark, catalog, members=members, process_deletions=False)
    kept = shown(drain_now(stream(), upkeep, checkpoint))
    assert kept["prototypes"] == {1: [0.0, 1.0], 2: [4.0, 0.0], 3: [7.0, 7.0]}


def test_streams_read_a_file_or_a_folder_of_files(spark, tmp_path):
    from nearfield.operators.maintenance import deletion_queue
    from nearfield.sources.sample import SampleCatalog

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "folder" / "events.parquet"))
    for name, folder in (("folder", str(tmp_path / "folder")), ("file", "/root/testdata/sf0.001")):
        sample = SampleCatalog(spark, folder)
        out = scratch_path(spark, name)
        queues.write_queue(queues.stream_deletion_queue(sample.change_stream()), out, scratch_path(spark, "checkpoint")).awaitTermination()
        got = sorted(tuple(r) for r in queues.read_deletion_queue(spark, out).select("image_id", "queued_at").collect())
        assert got == sorted(tuple(r) for r in deletion_queue(sample.changes()).select("image_id", "queued_at").collect()) and got


def test_state_of_another_checkpoint_is_not_overwritten(spark, catalog):
    upkeep, _ = start(spark, catalog)
    done = spark.createDataFrame([(True,)], "done boolean")
    done.write.parquet(upkeep.state_path("committed", 4))
    with pytest.raises(ValueError):
        upkeep.process(spark.createDataFrame([], CHANGE), 0)
