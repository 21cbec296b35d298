"""Jobs composed of the operators: prepare, train, study, report."""
