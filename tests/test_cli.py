"""The command line runs the same jobs."""

import json

from orewash.__main__ import main


def test_layers_one_by_one(spark, tmp_path):
    def put(dataset, *records):
        folder = tmp_path / "landing" / dataset
        folder.mkdir(parents=True)
        (folder / "a.json").write_text("".join(json.dumps(r) + "\n" for r in records))

    put("users", {"user_id": "u", "city": "Rome", "age": "30", "updated_at": "2024-01-01"})
    put("events", {"event_id": "1", "user_id": "u", "ts": "2024-01-02T03:04:05", "country": "IT"})
    put("transactions", {"tx_id": "1", "user_id": "u", "created_at": "2024-01-02", "amount": "1,000", "status": "delivered"})
    root = ["--root", str(tmp_path), "--gold", str(tmp_path / "elsewhere")]
    main(["silver", *root])
    main(["gold", *root])
    main(["load", *root, "--database", "cli_gold", "--location", str(tmp_path / "db")])
    assert spark.table("cli_gold.user_ltv").first()["ltv"] == 1000.0
    assert spark.read.parquet(f"{tmp_path}/elsewhere/fact_events").first()["user_city"] == "Rome"
