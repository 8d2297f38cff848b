"""DataFrame operators: windows, aggregates, sampling, evaluation, models and segments."""
