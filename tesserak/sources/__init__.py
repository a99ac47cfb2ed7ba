"""Where rows come from: readers and the binding of tables to the model."""
