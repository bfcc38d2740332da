"""Where rows come from: landed pages, a paged review API, catalog tables."""
