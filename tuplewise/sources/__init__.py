"""Where rows come from: tables, JSON files, query logs."""
