"""Recognition of faults in device logs: gate, ordered fold, correlation, groups and pages."""
