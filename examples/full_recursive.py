"""Recursive clustering of a published family."""

from examples.family import main
from quillon.plans import workflows

if __name__ == "__main__":
    main(__doc__, "full_recursive", "308", lambda spark, folder, output, family: workflows.run_full_recursive(spark, f"{folder}/pairwise_ml_distance.mldist", f"{folder}/alignment.fasta", f"{folder}/labels.csv", output, family))
