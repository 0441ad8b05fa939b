"""DataFrame operators: per-video questions, dataset profiling, statistics, evaluation."""
