"""The baseline that only splits in two, on a published family."""

from examples.family import main
from quillon.plans import workflows

if __name__ == "__main__":
    main(__doc__, "fixed_binary_baseline", "308", lambda spark, folder, output, family: workflows.run_fixed_binary_baseline(spark, f"{folder}/pairwise_ml_distance.mldist", f"{folder}/alignment.fasta", f"{folder}/labels.csv", output, family))
