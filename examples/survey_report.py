"""Run every dashboard computation on a survey file and write the result tables.

    python examples/survey_report.py SURVEY_PATH OUT_DIR [csv|parquet]

The survey needs the 20 survey columns (extra columns are kept; a missing
``respondent_id`` is generated). On a cluster, set ``spark.checkpoint.dir`` to a
shared folder first.
"""
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from surveykit.operators.describe import validate_survey  # noqa: E402
from surveykit.plans.analyses import compute_all  # noqa: E402
from surveykit.session import get_session  # noqa: E402
from surveykit.sources.sinks import write_results  # noqa: E402
from surveykit.sources.survey import read_survey  # noqa: E402


def main(path: str, out_dir: str, fmt: str = "csv") -> None:
    spark = get_session()
    survey = read_survey(spark, path, fmt).checkpoint(eager=True)
    problems = validate_survey(survey).where("n_bad <> 0").collect()   # bounded: rules × columns
    for p in problems:
        print(f"warning: {p['column_name']} {p['rule']}: {p['n_bad']}")
    summary = write_results(compute_all(survey), out_dir)
    summary.show(truncate=False)


if __name__ == "__main__":
    main(*sys.argv[1:])
