"""python -m crestline cluster | legacy | evaluate | experiment"""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import functions as F

from crestline.operators import density, sketch
from crestline.operators.centers import MAX_FLOAT
from crestline.operators.graphs import KINDS
from crestline.operators.metrics import METRICS, evaluate
from crestline.plans import dpc
from crestline.session import keep, session, ship
from crestline.sources import sinks, text

DENSITIES = {"KthDistance": density.kth, "Normalized": density.normalized, "ExpSquared": density.exp_squared, "MutualKNN": density.mutual, "RaceDensityComputer": None}


def _options(parser: argparse.ArgumentParser) -> None:
    parser.add_argument("--query_file", required=True)
    for name, kind, value in (("K", int, 6), ("L", int, 12), ("Lnn", int, 4), ("Lbuild", int, 12), ("max_degree", int, 16), ("alpha", float, 1.2), ("num_clusters", int, 4)):
        parser.add_argument(f"--{name}", type=kind, default=value)
    parser.add_argument("--output_file", default="")
    parser.add_argument("--decision_graph_path", default="")
    for name, value in (("density_cutoff", 0.0), ("center_density_cutoff", 0.0), ("dist_cutoff", MAX_FLOAT)):
        parser.add_argument(f"--{name}", type=float, default=value)
    parser.add_argument("--method", default="Doubling")
    parser.add_argument("--graph_type", choices=KINDS, default="Vamana")


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="crestline")
    commands = top.add_subparsers(dest="command", required=True)
    one = commands.add_parser("cluster", help="cluster a text file of vectors, centers by thresholds")
    _options(one)
    one.add_argument("--density_method", choices=list(DENSITIES), default="KthDistance")
    _options(commands.add_parser("legacy", help="the older form, which honours --density_cutoff"))
    scored = commands.add_parser("evaluate", help="metrics of a file of labels against the true ones, as JSON")
    scored.add_argument("gt")
    scored.add_argument("cluster")
    many = commands.add_parser("experiment", help="all combinations of search widths, graphs, K and densities over one Parquet table <id, features[, label]>")
    many.add_argument("dataset")
    many.add_argument("num_clusters", type=int)
    many.add_argument("--timeout", type=float, default=20)
    many.add_argument("--results_file_prefix", default="results")
    many.add_argument("--dont_compare_against_gt", action="store_true")
    many.add_argument("--dont_compare_against_bf", action="store_true")
    many.add_argument("--search_range", type=int, nargs="+", default=[8, 16, 32, 64])
    many.add_argument("--graph_types", nargs="+", choices=KINDS, default=["Vamana"])
    many.add_argument("--Ks", type=int, nargs="+", default=[16])
    many.add_argument("--density_methods", nargs="+", default=["kth"])
    return top


def experiment(spark, args) -> None:
    """A row of results for each configuration, against the truth and against exact labels of the same K and density."""
    table = spark.read.parquet(args.dataset)
    pts = keep(table.select("id", "features"))
    truth = None if args.dont_compare_against_gt else table.select("id", "label")
    exact: dict[tuple, object] = {}
    path = f"{args.results_file_prefix}_{time.strftime('%Y%m%d_%H%M%S')}"
    for config in dpc.configurations(args.search_range, args.graph_types, args.Ks, args.density_methods):
        center = dpc.Product(args.num_clusters, config["density_computer"] == "normalized")
        (_, found, _), = dpc.run_configurations(pts, [config], center, timeout=args.timeout)
        if found is None:
            continue
        against = {} if truth is None else {"ground truth": truth}
        if not args.dont_compare_against_bf:
            key = (config["K"], config["density_computer"])
            if key not in exact:
                exact[key] = dpc.cluster(pts, K=config["K"], density_computer=config["density_computer"], center_finder=center, graph_type="BruteForce").clusters
            against["brute force"] = exact[key].withColumnRenamed("cluster", "label")
        for name, labels in against.items():
            row = {"dataset": args.dataset, "method": config["method"], "comparison": name} | {k: v for k, v in found.metadata.items() if k != "Output time"} | evaluate(labels, found.clusters)
            sinks.append_results(spark.createDataFrame([row]), path)


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = session()
    ship(spark)
    if args.command == "evaluate":
        print(json.dumps(evaluate(text.labels(spark, args.gt), text.labels(spark, args.cluster, "cluster"), tuple(METRICS))))
        return
    if args.command == "experiment":
        experiment(spark, args)
        return
    pts = keep(text.vectors(spark, args.query_file))
    if args.L <= args.K and args.graph_type != "BruteForce":
        print("warning: L <= K, so every neighbour list is searched exactly")
    shared = {name: getattr(args, name) for name in ("K", "L", "Lnn", "Lbuild", "max_degree", "alpha", "num_clusters", "graph_type")}
    if args.command == "legacy":
        found = dpc.legacy_cluster(pts, rho_cutoff=args.density_cutoff, delta_cutoff=args.dist_cutoff, center_rho_cutoff=args.center_density_cutoff, **shared)
        sinks.clusters(found.clusters, args.output_file)
        sinks.decision_graph(found.graph, args.decision_graph_path, text=True)
    else:
        how = DENSITIES[args.density_method] or (lambda knn: sketch.race_density(pts, *sketch.defaults(pts.count())))
        center = dpc.Threshold(args.dist_cutoff, args.center_density_cutoff)
        found = dpc.cluster(pts, center_finder=center, density_computer=how, method=args.method, output_path=args.output_file, decision_graph_path=args.decision_graph_path, **shared)
        print(json.dumps(found.metadata))
    print("clusters:", found.clusters.agg(F.countDistinct("cluster")).first()[0])


if __name__ == "__main__":
    main()
