"""Lines that the test views append to documents, per file family.

All keys are fake.  They are written in two halves so that no scanner of this
repository takes them for live credentials.
"""

AWS = "AK" + "IA1234567890ABCDEF"
AWS2 = "AK" + "IA1234ZZZZ99ABCDEF"
GITHUB = "gh" + "p_0123456789abcdefghijklmnopqrstuvwxyz"
STRIPE = "sk" + "_live_51Hq8xZkL2mNvB7cD4eF1gH3"
SLACK = "xo" + "xb-123456789012-abcdefABCDEF"
OPENAI = "sk" + "-abcdefghijklmnopqrstuvwxyz0123456789ABCD"
NPM = "np" + "m_0123456789abcdefghijklmnopqrstuvwxyz"
JWT = "ey" + "JhbGciOiJIUzI1NiJ9.ey" + "JzdWIiOiIxMjM0NTY3.c2lnbmF0dXJlLXBhcnQ"
PG = "postgres" + "ql://admin:Pr0dPass99x@db.internal:5432/main"
PASSWORD = "Hunter2" + "Winter99"
RAW_VALUES = [AWS, AWS2, GITHUB, STRIPE, SLACK, OPENAI, NPM, JWT, PG, PASSWORD]

CODE = [
    'cursor.execute("SELECT * FROM t WHERE id = " + user_id)',
    'cursor.execute(f"SELECT * FROM t WHERE id = {user_id}")',
    'query = "SELECT * FROM t WHERE id = %s" % user_id',
    'message = "{} is here".format(name)',
    'node.innerHTML = data.userContent;',
    'document.write(message);',
    'return Markup(text)',
    'subprocess.run("ping " + host, shell=True, verify=False)',
    'os.system(cmd)',
    'return str(eval(expr))',
    'data = pickle.loads(blob)',
    'cfg = yaml.load(stream)',
    'cfg = yaml.load(stream, Loader=yaml.SafeLoader)',
    'cfg = yaml.load("{}".format(stream))',
    'cfg = yaml.unsafe_load(stream)',
    'x = marshal.loads(b)',
    'Process p = Runtime.getRuntime().exec(cmd);',
    'Object o = in.readObject();',
    'x = unserialize(d);',
    '$out = shell_exec($cmd);',
    'obj = Marshal.load(data)',
    'child_process.execSync(cmd)',
    'const f = new Function("a", body);',
    'exec(code)',
    'return render_template_string(src)',
    'const h = { alg: "none" }',
    'h = hashlib.md5(pw).hexdigest()',
    'h = hashlib.sha1(pw).hexdigest()',
    'token = random.choice(letters)',
    'app.run(host="0.0.0.0", debug=True)',
    "res.set('Access-Control-Allow-Origin', '*'); // Access-Control-Allow-Origin: *",
    'requests.get(url, verify=False)',
    'const o = { rejectUnauthorized: false }',
    'NODE_TLS_REJECT_UNAUTHORIZED=0',
    'conf := &tls.Config{InsecureSkipVerify: true}',
    'ctx = ssl._create_unverified_context()',
    'server = "10.0.0.17"',
    'eval(x)  # nosec code',
    'eval(y)  # nosec secret',
    'eval(z)  // nosec',
    'pickle.load(f)  # nosec because code is trusted',
    'print("plain line, nothing to see")',
    f'AWS_ACCESS_KEY_ID = "{AWS}"',
    f'GITHUB_TOKEN = "{GITHUB}"  # nosec code',
    f'STRIPE_KEY = "{STRIPE}"  # nosec secret',
    f'DATABASE_URL = "{PG}"',
    f'password = "{PASSWORD}"',
    f'slack("{SLACK}"); openai("{OPENAI}")',
    f'jwt = "{JWT}"',
    f'keys = ["{AWS}", "{AWS2}"]',
    '-----BEGIN RSA ' + 'PRIVATE KEY-----',
    '# eval(in_a_comment) still counts in code',
    '   spaced_out = eval ( value )   ',
]

DOCKER = [
    'FROM ubuntu\nENV API_KEY=secret123\nRUN chmod -R 777 /app',
    'FROM python:3.12\nUSER app\nRUN apt-get install curl',
    'FROM node:latest\nADD https://example.org/x.tgz /x\nRUN curl -s https://example.org/i.sh | sudo bash',
    'FROM alpine@sha256:abc\nRUN apt-get install --no-install-recommends git\nUSER 1000',
    'FROM busybox # nosec\nRUN chmod 777 /tmp && wget -qO- https://example.org/i | sh',
    'FROM debian:12\n# ENV TOKEN=abc\n  ENV DB_PASSWORD abc123def\nRUN chmod 777 /x # nosec code',
    f'FROM scratch\nARG NPM_TOKEN={NPM}',
]

IAC = [
    'ingress { cidr_blocks = ["0.0.0.0/0"] }',
    f'password = "{PASSWORD}"',
    'encrypted = false',
    'acl = "public-read"',
    'privileged: true',
    'network_mode: "host"',
    '- /var/run/docker.sock:/var/run/docker.sock',
    'skip_tls_verify: true',
    '# privileged: true',
    'password = "${var.secret}"',
    'encrypted = false # nosec',
    'privileged: false',
]

WORKFLOW = [
    'on: pull_request_target',
    '  - uses: vendor/tool@v2.1',
    '  - uses: actions/checkout@v4',
    '  - uses: vendor/tool@8f4b7f84864484a7bf31766abe9204da3cbe65b3',
    '  run: curl -s https://example.org/i.sh | bash',
    '  run: echo ${{ secrets.TOKEN }}',
    'permissions: write-all',
    '  run: echo "${{ github.event.pull_request.title }}"',
    f'  DEPLOY_TOKEN: "{GITHUB}"',
    '  # permissions: write-all',
    'permissions: write-all # nosec: code',
    'permissions: read-all',
]

IGNORE_FILES = [
    '# nothing here',
    'svc*/\n*.php\n',
    'infra/**\n**/app_?.js\n\n# comment\ncore\\*.java',
]

GITIGNORES = [
    '*.pem\n.env\n',
    '# keys\n*.key\nid_rsa\n',
    'build/\ndist\n',
    '*.pyc\n',
]
