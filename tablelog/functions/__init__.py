"""Table functions over snapshots, utilities and observability."""
