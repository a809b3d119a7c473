"""One-shot clustering of a published family."""

from examples.family import main
from quillon.plans import workflows

if __name__ == "__main__":
    main(__doc__, "quick_start", "372", lambda spark, folder, output, family: workflows.run_quick_start(spark, f"{folder}/pairwise_ml_distance.mldist", f"{folder}/labels.csv", output, family))
