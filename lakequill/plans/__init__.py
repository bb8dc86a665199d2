"""Plans of operators: the method catalog, evaluation runs, driver queries."""
