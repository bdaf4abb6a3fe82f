"""End-to-end jobs: build lineups, project players, report on lineups, train models."""
