"""Table readers, release feeds and the scratch area for written intermediates."""
