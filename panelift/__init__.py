"""Impact analytics on Spark: weekly panels, cleaning, profiling, explainable models, diagnostics."""
