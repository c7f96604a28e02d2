"""The fares source, collecting, the command line and the stream."""

import json
import logging
import threading
import time
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from ternway import cli, schemas
from ternway.operators.collection import fetched, requests
from ternway.operators.network import build_network
from ternway.plans.collect import collect
from ternway.plans.network import network_at
from ternway.plans.search import Options, search
from ternway.sinks import documents
from ternway.sources.files import Flights, Network, read_airports, read_flight_file, write_network_tables
from ternway.streaming.arrivals import second_leg_stream, stream_journeys


@pytest.fixture(scope="module")
def recorded(tmp_path_factory):
    folder = tmp_path_factory.mktemp("answers")
    flight = {"departure_at": "2026-02-19T10:00:00+03:00", "duration": 240, "price": 100, "airline": "SU", "flight_number": 7}
    (folder / "MOW-ANY-2026-02-19.json").write_text(json.dumps({"data": [flight | {"origin": "MOW", "destination": "IST"}, flight | {"origin": "MOW", "destination": "DXB"}]}))
    (folder / "ANY-BKK-2026-02-21.json").write_text(json.dumps({"data": [{"origin": "IST", "destination": "BKK", "departure_at": "2026-02-21T14:00:00+03:00", "price": 200}]}))
    (folder / "ANY-BKK-2026-02-22.json").write_text("{}")
    return str(folder)


def test_collect(spark, recorded, tmp_path):
    found = collect(spark, "MOW", "BKK", ("2026-02-19", "2026-02-19"), ("2026-02-21", "2026-02-22"), recorded=recorded)
    meta = found.metadata.first()
    assert (meta.total_flights, meta.intermediate_airports) == (3, ["DXB", "IST"])
    documents.save_flights(found, str(tmp_path / "f.json"))
    back = read_flight_file(spark, str(tmp_path / "f.json"))
    assert back.leg1.count() == 2 and back.leg2.first().search_date == "2026-02-21" and back.leg2.first().search_destination == "BKK"


def test_errors_can_be_empty(spark, recorded):
    found = collect(spark, "MOW", None, ("2026-02-19", "2026-02-20"), recorded=recorded, errors="empty")
    assert found.leg1.count() == 2


def test_command_line(spark, recorded, tmp_path, capsys):
    flights, network, out = (str(tmp_path / x) for x in ("f.json", "n.json", "r.json"))
    assert cli.main(["collect", "MOW", "BKK", "--leg1-dates", "2026-02-19", "2026-02-19", "--leg2-dates", "2026-02-21", "2026-02-22", "--recorded", recorded, "--output", flights]) == 0
    spark.createDataFrame([("SVO", "55.97, 37.41", "S", "Moscow", "RU"), ("DME", "55.41, 37.90", "D", "Moscow", "RU"), ("", "1,1", "", "", "")], "iata_code string, coordinates string, name string, municipality string, iso_country string").write.parquet(str(tmp_path / "a"))
    assert cli.main(["network", str(tmp_path / "a"), "--output", network]) == 0
    assert cli.main(["search", flights, "--airport-network", network, "--output", out]) == 0
    assert json.loads(open(out).read())["statistics"]["total_combinations"] == 1
    assert cli.main(["search", str(tmp_path / "none.json")]) == 0
    said = capsys.readouterr()
    assert "2 airports, 2 connections" in said.out and "is missing" in said.err


def test_network_is_built_once(spark, tmp_path):
    rows = spark.createDataFrame([("SVO", "55.97, 37.41", "S", "Moscow", "RU"), ("DME", "55.41, 37.90", "D", "Moscow", "RU")], "iata_code string, coordinates string, name string, municipality string, iso_country string")
    rows.write.parquet(str(tmp_path / "a"))
    assert network_at(spark, str(tmp_path / "n")) is None
    assert network_at(spark, str(tmp_path / "n"), lambda: read_airports(spark, str(tmp_path / "a"))).edges.count() == 2
    assert network_at(spark, str(tmp_path / "n")).edges.count() == 2


def test_networks_that_were_begun_are_not_read(spark, tmp_path, caplog):
    path = str(tmp_path / "n")
    rows = spark.createDataFrame([(0, "SVO", "55.97, 37.41", "S", "Moscow", "RU"), (1, "DME", "55.41, 37.90", "D", "Moscow", "RU")], "pos long, iata_code string, coordinates string, name string, municipality string, iso_country string")
    near, far = build_network(rows, 10.0), build_network(rows, 100.0)
    bad = Network(near.airports, near.edges.withColumn("dst", F.raise_error(F.lit("killed")).cast("string")).union(far.edges.withColumn("dst", F.raise_error(F.lit("killed")).cast("string"))), 10.0)
    with pytest.raises(Exception, match="killed"):
        write_network_tables(bad, path)
    assert network_at(spark, path) is None
    write_network_tables(far, path)
    with pytest.raises(Exception, match="killed"):
        write_network_tables(bad, path)
    assert (network_at(spark, path).edges.count(), network_at(spark, path).max_km) == (2, 100.0)
    with ThreadPoolExecutor(2) as both:  # two builders at once: either network, whole
        list(both.map(lambda n: write_network_tables(n, path), (near, near)))
    found = network_at(spark, path)
    assert (found.airports.count(), found.edges.count(), found.max_km) == (2, 0, 10.0)
    flights = Flights(*(spark.createDataFrame([], f"pos long, {schemas.FLIGHT}") for _ in range(2)), None)
    with caplog.at_level(logging.WARNING):
        search(flights, found, Options(max_km=10.0))
        assert "the network holds" not in caplog.text
        search(flights, found, Options(max_km=50.0))
    assert "the network holds airports up to 10 km from each other, not 50" in caplog.text


class Answers(BaseHTTPRequestHandler):
    """Answers by day: 19 one flight by origin, 20 fails once, 21 is unknown, 22 is no JSON, 23 comes too late."""

    seen: list = []

    def do_GET(self):
        query = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        before = sum(q == query for q, _ in self.seen)
        self.seen.append((query, self.headers.get("X-Access-Token")))
        day = query.get("departure_at", "")[-2:]
        code = 404 if day == "21" else 503 if day == "20" and not before else 200
        if day == "23":
            time.sleep(1.5)
        body = b"{" if day == "22" else json.dumps({"data": [{"origin": query.get("origin"), "destination": "IST", "price": 5}] * 3}).encode()
        try:
            self.send_response(code)
            self.end_headers()
            self.wfile.write(body)
        except OSError:  # the other side has given up
            pass

    def log_message(self, *_):
        pass


@pytest.fixture
def server():
    Answers.seen = []
    http = ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_address[1]}/prices"
    http.shutdown()


def test_requests_over_http(spark, server):
    asked = requests(spark, "MOW", None, ("2026-02-19", "2026-02-23"))
    options = {"url": server, "token_env": "TERNWAY_TEST_TOKEN", "pause_s": "0.01", "timeout_s": "0.5", "retries": "1", "slots": 2}
    found = fetched(asked, errors="empty", limit="2", **options)
    assert sorted((r.search_date, r.price) for r in found.collect()) == [(f"2026-02-{d}", 5.0) for d in (19, 19, 20, 20)]
    times = Counter(q["departure_at"][-2:] for q, _ in Answers.seen)
    assert times == {"19": 1, "20": 2, "21": 1, "22": 1, "23": 2}  # what can't be served now is asked again
    query, token = Answers.seen[0]
    assert token == "secret" and "token" not in query and query["unique"] == "true" and query["limit"] == "2" and query["origin"] == "MOW" and "destination" not in query
    with pytest.raises(Exception, match="404"):
        fetched(asked.where("date = '2026-02-21'"), **options).collect()


def test_filters_leave_out_requests(spark, server):
    asked = requests(spark, "MOW", "BKK", ("2026-02-01", "2026-02-09"), ("2026-02-11", "2026-02-12"), ["A", "B"])
    found = fetched(asked, url=server, token_env="TERNWAY_TEST_TOKEN", token_parameter="token", unique="false", pause_s="0")
    some = found.where("leg = 'leg1' and search_destination in ('A', 'C') and search_date >= '2026-02-05' and search_date < '2026-02-08' and price > 1")
    assert some.count() == 9
    assert sorted((q["destination"], q["departure_at"]) for q, _ in Answers.seen) == [("A", f"2026-02-0{d}") for d in (5, 6, 7)]
    assert all(q["token"] == "secret" and t is None and "unique" not in q for q, t in Answers.seen)
    assert found.where("search_origin is null").count() == 0 and found.where("search_destination <=> 'BKK'").count() == 12


def test_csv_airports_keep_na(spark, tmp_path):
    (tmp_path / "a.csv").write_text('iata_code,coordinates,name,municipality,iso_country\nWDH,"-22.5, 17.5",W,Windhoek,NA\n')
    assert read_airports(spark, str(tmp_path / "a.csv"), "csv").first().iso_country == "NA"


def test_stream(spark, recorded, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(json.dumps({"pos": 0, "origin": "IST", "destination": "BKK", "departure_at": "2026-02-21T14:00:00", "price": 5.0}))
    leg1 = collect(spark, "MOW", None, ("2026-02-19", "2026-02-19"), recorded=recorded).leg1
    q = stream_journeys(second_leg_stream(spark, str(tmp_path / "in")), leg1, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert [r.total_price for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [105.0]
