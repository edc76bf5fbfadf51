"""DataFrame operators: reports, quality audits, batch changes, booking."""
