import hashlib

import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline
from gleaner.staging import GROUP


def test_stages_hand_on_row_groups_of_bounded_size(spark, tmp_path, monkeypatch):
    texts = ["".join(hashlib.sha256(f"{k} {i}".encode()).hexdigest() for i in range(400)) for k in range(1000)]
    pq.write_table(pa.table({"doc_id": range(1000), "text": texts}), tmp_path / "documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, lambda spark, docs, sf_dir: docs) for name in ("first stage", "last stage")])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r["text"] for r in out.collect()) == sorted(texts)
    groups = [m.row_group(k).total_byte_size for f in out.inputFiles() if (m := pq.read_metadata(f.removeprefix("file://"))).num_rows for k in range(m.num_row_groups)]
    assert sum(groups) > 2 * GROUP and max(groups) < 1.5 * GROUP
