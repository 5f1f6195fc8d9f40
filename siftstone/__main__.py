from siftstone.cli import main

main()
