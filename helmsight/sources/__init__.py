"""Where rows come from: topic tables and streams, and adapters over event logs."""
