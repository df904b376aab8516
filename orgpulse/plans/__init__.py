"""End-to-end plans: staging, the fixture report, registered queries, oracles."""
